"""Text sizes under zstandard dictionaries, and bounded training samples."""
from __future__ import annotations

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ship import ship

LEVEL = 3
BLOCK = 2048  # bytes; a long text is compressed block by block, so the dictionary counts throughout


def sizer(dictionary: bytes, raw: bool, **params):
    """bytes -> compressed size with this dictionary, block by block. params: of
    ZstdCompressionParameters, else LEVEL's."""
    p = zstandard.ZstdCompressionParameters.from_level(LEVEL, write_content_size=False, write_dict_id=False, write_checksum=False, **params)
    d = None
    if dictionary:
        d = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT if raw else zstandard.DICT_TYPE_AUTO)
        d.precompute_compress(compression_params=p)
    c = zstandard.ZstdCompressor(compression_params=p, dict_data=d)

    def size(t: bytes) -> int:
        if len(t) <= BLOCK:
            return len(c.compress(t))
        return sum(len(c.compress(t[i : i + BLOCK])) for i in range(0, len(t), BLOCK))

    return size


def id_crc(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def id_order(doc_id: Column) -> Column:
    return F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def add_columns(docs: DataFrame, text: str, schema: str, fields: list[pa.DataType], make) -> DataFrame:
    """docs with columns added: make() gives, on the executor, a function from a text or None to
    their values. A column of the same name in docs gives way."""
    ship(docs.sparkSession)
    names = [x.split()[0] for x in schema.split(", ")]
    kept = docs.drop(*names)
    full = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema) + ", " + schema
    columns = kept.columns
    at = columns.index(text)

    def run(batches):
        one = make()
        for b in batches:
            got = [one(t.as_py()) for t in b.column(at)]
            new = [pa.array([g[k] for g in got], kind) for k, kind in enumerate(fields)]
            yield pa.RecordBatch.from_arrays([*b.columns, *new], names=[*columns, *names])

    return kept.mapInArrow(run, full)
