"""Genotype files: PLINK BED, PACKEDANCESTRYMAP (also transposed) and EIGENSTRAT, read as (variant_idx, sample_id, pop, dosage).

All of them are records of one length: of a variant or, in transposed files, of a sample. A Python data source cuts a file
into ranges of records; each task opens its range alone.
"""
from __future__ import annotations

import os

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Fixed values of the formats: BED magic and codes (low bits first; 1 is missing), packed record header (high bits first; 3 is missing).
BED_MAGIC = b"\x6c\x1b\x01"
BED_DOSAGE = (2, -1, 1, 0)
PACKED_MIN_RECORD = 48
VARIANTS_A_TASK = 4096


def format_of(prefix: str) -> str:
    """plink, pfile, packedancestrymap or eigenstrat, by the files beside the prefix."""
    if os.path.exists(prefix + ".bed"):
        return "plink"
    if os.path.exists(prefix + ".pgen"):
        return "pfile"
    if os.path.exists(prefix + ".geno"):
        return "packedancestrymap" if is_packed(prefix + ".geno") else "eigenstrat"
    raise FileNotFoundError(f"no genotype files at {prefix}")


def is_packed(path: str) -> bool:
    with open(path, "rb") as f:
        return f.read(4) in (b"GENO", b"TGEN")


def is_transposed(path: str) -> bool:
    with open(path, "rb") as f:
        return f.read(4) == b"TGEN"


def line_width(path: str) -> int:
    """Bytes of a line of a text file whose lines are all as long."""
    with open(path, "rb") as f:
        return len(f.readline())


def samples(spark: SparkSession, prefix: str, kind: str | None = None) -> pd.DataFrame:
    """sample_id, sex, pop in file order."""
    kind = kind or format_of(prefix)
    if kind == "plink":
        t = pd.read_csv(prefix + ".fam", sep=r"\s+", header=None, dtype=str, keep_default_na=False)
        return pd.DataFrame({"sample_id": t[1], "sex": t[4], "pop": t[0]})
    if kind == "pfile":
        return read_psam(prefix + ".psam")
    t = pd.read_csv(prefix + ".ind", sep=r"\s+", header=None, dtype=str, keep_default_na=False)
    return pd.DataFrame({"sample_id": t[0], "sex": t[1], "pop": t[2]})


def read_psam(path: str) -> pd.DataFrame:
    lines = [x for x in open(path).read().splitlines() if x and not x.startswith("##")]
    head = lines[0].lstrip("#").split()
    t = pd.DataFrame([x.split() for x in lines[1:]], columns=head)
    return pd.DataFrame({"sample_id": t["IID"], "sex": t.get("SEX", "0"), "pop": t.get("FID", "0")})


def read_pvar(path: str, multiallelic: str = "error") -> pd.DataFrame:
    """VCF-shaped variant table; multiallelic rows are an error, skipped, or keep their first alternative."""
    lines = [x for x in open(path).read().splitlines() if x and not x.startswith("##")]
    head = lines[0].lstrip("#").split("\t")
    t = pd.DataFrame([x.split("\t") for x in lines[1:]], columns=head)
    multi = t["ALT"].str.contains(",")
    if multi.any() and multiallelic == "error":
        raise ValueError(f"{int(multi.sum())} multiallelic variants")
    out = pd.DataFrame({"variant_idx": range(len(t)), "snp": t["ID"], "chr": t["CHROM"], "cm": t.get("CM", "0").astype(float) if "CM" in t else 0.0, "pos": t["POS"].astype(float), "a1": t["REF"], "a2": t["ALT"].str.split(",").str[0]})
    return out[~multi] if multiallelic == "skip" else out


_SNP = "snp string, chr string, cm double, pos double, a1 string, a2 string"


def variants(spark: SparkSession, prefix: str, kind: str | None = None) -> DataFrame:
    """variant_idx (file order), snp, chr, cm, pos, a1, a2."""
    kind = kind or format_of(prefix)
    order = {"plink": (".bim", [1, 0, 2, 3, 4, 5])}.get(kind, (".snp", [0, 1, 2, 3, 4, 5]))
    if kind == "pfile":
        return spark.createDataFrame(read_pvar(prefix + ".pvar", "first_alt"))
    t = pd.read_csv(prefix + order[0], sep=r"\s+", header=None, dtype=str, keep_default_na=False)[order[1]]
    t.columns = ["snp", "chr", "cm", "pos", "a1", "a2"]
    t = t.astype({"cm": float, "pos": float})
    t.insert(0, "variant_idx", np.arange(len(t)))
    return spark.createDataFrame(t, f"variant_idx long, {_SNP}")


def decode_bed(raw: bytes, n: int) -> np.ndarray:
    """Records of ceil(n / 4) bytes -> variants x n dosages, -1 missing."""
    b = np.frombuffer(raw, np.uint8).reshape(-1, -(-n // 4))
    codes = np.stack([b >> s & 3 for s in (0, 2, 4, 6)], axis=-1).reshape(len(b), -1)[:, :n]
    return np.array(BED_DOSAGE, np.int8)[codes]


def encode_bed(g: np.ndarray) -> bytes:
    back = np.zeros(4, np.uint8)
    for code, d in enumerate(BED_DOSAGE):
        back[d] = code
    c = back[g]
    c = np.pad(c, ((0, 0), (0, -g.shape[1] % 4))).reshape(len(g), -1, 4)
    return (c << np.array([0, 2, 4, 6], np.uint8)).sum(2, dtype=np.uint8).tobytes()


def decode_packed(raw: bytes, n: int) -> np.ndarray:
    b = np.frombuffer(raw, np.uint8).reshape(-1, max(PACKED_MIN_RECORD, -(-n // 4)))
    codes = np.stack([b >> s & 3 for s in (6, 4, 2, 0)], axis=-1).reshape(len(b), -1)[:, :n].astype(np.int8)
    return np.where(codes == 3, -1, codes).astype(np.int8)


def encode_packed(g: np.ndarray) -> bytes:
    width = max(PACKED_MIN_RECORD, -(-g.shape[1] // 4))
    c = np.where(g < 0, 3, g).astype(np.uint8)
    c = np.pad(c, ((0, 0), (0, 4 * width - g.shape[1]))).reshape(len(g), width, 4)
    return (c << np.array([6, 4, 2, 0], np.uint8)).sum(2, dtype=np.uint8).tobytes()


class _Range(InputPartition):
    def __init__(self, first: int, last: int) -> None:
        self.first, self.last = first, last


class GenotypeSource(DataSource):
    """format("freqforge-geno"): options path, kind (plink, packedancestrymap, transposed or eigenstrat), samples and, for
    transposed files, variants (numbers), from, to (variants)."""

    @classmethod
    def name(cls) -> str:
        return "freqforge-geno"

    def schema(self) -> str:
        return "variant_idx long, sample_no int, dosage byte"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def decode_lines(raw: bytes, width: int, n: int) -> np.ndarray:
    """Lines of digits, 9 missing -> records x n."""
    d = np.frombuffer(raw, np.uint8).reshape(-1, width)[:, :n].astype(np.int8) - 48
    return np.where(d == 9, -1, d).astype(np.int8)


class _Reader(DataSourceReader):
    def __init__(self, options) -> None:
        self.path, self.kind, self.n = options["path"], options["kind"], int(options["samples"])
        self.cells = int(options["variants"]) if self.kind == "transposed" else self.n  # of a record
        packed = max(PACKED_MIN_RECORD, -(-self.cells // 4))
        self.width = {"plink": -(-self.n // 4), "eigenstrat": int(options.get("width", self.n + 1))}.get(self.kind, packed)
        self.skip = {"plink": len(BED_MAGIC), "eigenstrat": 0, "transposed": PACKED_MIN_RECORD}.get(self.kind, self.width)
        size = os.path.getsize(self.path) - self.skip
        total = -(-size // self.width) if self.kind == "eigenstrat" else size // self.width  # the last line may have no end
        self.between = int(options.get("from", 0)), int(options.get("to", 1 << 62))
        a, b = (0, self.n) if self.kind == "transposed" else self.between
        self.first, self.last = a, min(total, b)

    def partitions(self):
        step = max(1, VARIANTS_A_TASK * self.n // max(1, self.cells)) if self.kind == "transposed" else VARIANTS_A_TASK
        return [_Range(a, min(self.last, a + step)) for a in range(self.first, self.last, step)] or [_Range(0, 0)]

    def read(self, part):
        import pyarrow as pa

        with open(self.path, "rb") as f:
            f.seek(self.skip + part.first * self.width)
            raw = f.read((part.last - part.first) * self.width)
        if self.kind == "eigenstrat":
            g = decode_lines(raw.ljust((part.last - part.first) * self.width, b"\n"), self.width, self.n)
        else:
            g = (decode_bed if self.kind == "plink" else decode_packed)(raw, self.cells)
        if self.kind == "transposed":
            a, b = max(0, self.between[0]), min(self.cells, self.between[1])
            g = g[:, a:b]
            s, v = np.meshgrid(np.arange(part.first, part.last, dtype=np.int32), np.arange(a, b, dtype=np.int64), indexing="ij")
        else:
            v, s = np.meshgrid(np.arange(part.first, part.last, dtype=np.int64), np.arange(self.n, dtype=np.int32), indexing="ij")
        flat = g.ravel()
        yield pa.RecordBatch.from_arrays([pa.array(v.ravel()), pa.array(s.ravel()), pa.array(flat, mask=flat < 0)], names=["variant_idx", "sample_no", "dosage"])


def genotypes(spark: SparkSession, prefix: str, inds: list[str] | None = None, pops: list[str] | None = None, first: int | None = None, last: int | None = None) -> DataFrame:
    """variant_idx, sample_id, pop, dosage of any format, for chosen samples and variants first..last (from 1)."""
    kind = format_of(prefix)
    who = samples(spark, prefix, kind)
    missing = [x for x in inds or [] if x not in set(who.sample_id)] + [p for p in pops or [] if p not in set(who["pop"])]
    if missing:
        raise ValueError(f"not in the sample file: {missing}")
    keep = who.reset_index(names="sample_no")
    keep = keep[(keep.sample_id.isin(inds) if inds else True) & (keep["pop"].isin(pops) if pops else True)] if inds or pops else keep
    a, b = (first or 1) - 1, last if last is not None else 1 << 62
    if kind == "pfile":
        raise NotImplementedError(".pgen records aren't decoded; convert to .bed")
    spark.dataSource.register(GenotypeSource)
    path = prefix + (".bed" if kind == "plink" else ".geno")
    src = spark.read.format("freqforge-geno").option("path", path).option("samples", len(who)).option("from", a).option("to", b)
    if kind == "eigenstrat":
        src = src.option("width", line_width(path))
    elif kind == "packedancestrymap" and is_transposed(path):
        with open(prefix + ".snp") as f:
            kind, src = "transposed", src.option("variants", sum(bool(x.strip()) for x in f))
    rows = src.option("kind", kind).load()
    names = spark.createDataFrame(keep[["sample_no", "sample_id", "pop"]], "sample_no int, sample_id string, pop string")
    return rows.join(names, "sample_no").select("variant_idx", "sample_id", "pop", "dosage")


def _matrix(geno: DataFrame, order: list[str]) -> np.ndarray:
    wide = geno.groupBy("variant_idx").pivot("sample_id", order).agg(F.first("dosage")).orderBy("variant_idx").toPandas()[order]
    return wide.fillna(-1).to_numpy(np.int8)


def write_plink(geno: DataFrame, who: pd.DataFrame, variant: pd.DataFrame, prefix: str) -> None:
    """One small file set, e.g. a sample subset; larger data belong in Parquet."""
    g = _matrix(geno, list(who.sample_id))
    with open(prefix + ".bed", "wb") as f:
        f.write(BED_MAGIC + encode_bed(g))
    pd.DataFrame({0: who["pop"], 1: who.sample_id, 2: "0", 3: "0", 4: who.sex, 5: "-9"}).to_csv(prefix + ".fam", sep="\t", header=False, index=False)
    variant[["chr", "snp", "cm", "pos", "a1", "a2"]].astype({"pos": int}).to_csv(prefix + ".bim", sep="\t", header=False, index=False)


def extract_samples(spark: SparkSession, prefix: str, out: str, inds: list[str] | None = None, pops: list[str] | None = None) -> None:
    """Any format -> PLINK, for chosen samples."""
    g = genotypes(spark, prefix, inds, pops)
    who = samples(spark, prefix)
    chosen = {r["sample_id"] for r in g.select("sample_id").distinct().collect()}
    write_plink(g, who[who.sample_id.isin(chosen)].reset_index(drop=True), variants(spark, prefix).orderBy("variant_idx").toPandas(), out)


packedancestrymap_to_plink = eigenstrat_to_plink = extract_samples
