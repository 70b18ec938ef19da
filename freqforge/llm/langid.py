"""Language identification by compression.

A zstandard raw-content dictionary holds text of each language; a text is compressed with
every one of them and the language of the smallest result is chosen. Texts, in dictionaries
too, are lower-cased and runs of anything but letters and their combining marks become a blank, so shouting and noise
look like prose; matches of four bytes count, as syllables tell languages apart. The score sets the
margin against the runner-up in relation to the text's size; below MARGIN the choice is
marked as rejected.

Dictionaries are filled from a bounded sample: about OVER * DICT_ROWS rows a language, those with
the smallest hashes of doc_id, and DICT_BYTES bytes of them; of texts above DICT_BYTES / 8 bytes the SLICE
characters from the first letter on. Rows with a letter count, so each learned language has a
dictionary. Every document is compressed whole. Languages are labels; MAX_LANGS of them, the most
frequent, can be learned.

Cases: null, empty and letterless texts are `und` with score 0; without anything to learn from
all are `und`; ties go to the first language by code point; equal rows get equal
results; an empty table gives no rows; other columns go along, ones that are named `lang_pred`, `score` or `rejected` give way.
"""
from __future__ import annotations

import re
import sys
import unicodedata
from functools import cache
from itertools import groupby

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read
from .zdict import add_columns, id_crc, id_order, sizer

FOLDS, HELD_OUT = 4, 2
DICT_ROWS = 400
OVER = 1.5
DICT_BYTES = 1 << 17
SLICE = DICT_BYTES // 32  # characters, of four bytes at most
MAX_LANGS = 256
MARGIN = 0.01
UND = "und"

#: match finder: matches of at least four bytes, sixteen attempts
PARAMS = dict(strategy=zstandard.STRATEGY_GREEDY, min_match=4, search_log=4, hash_log=17, chain_log=17, window_log=19)



@cache
def _class(kinds: str) -> str:
    """The characters whose Unicode category begins with one of kinds, as the body of a class."""
    inside = (c for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c))[0] in kinds)
    runs = ([c for _, c in g] for _, g in groupby(enumerate(inside), lambda x: x[1] - x[0]))
    return "".join(f"\\U{r[0]:08x}-\\U{r[-1]:08x}" for r in runs)


@cache
def _patterns() -> tuple[re.Pattern, re.Pattern]:
    return re.compile(f"[{_class('L')}]"), re.compile(f"[^{_class('LM')}]+")


def letters(text: str) -> str:
    """Lower-cased letters and combining marks with blanks between; empty without a letter."""
    letter, other = _patterns()
    return other.sub(" ", text.lower()) if letter.search(text) else ""


def fit(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> dict[str, bytes]:
    """A raw-content dictionary a language; docs holds only rows to learn from."""
    rows = docs.select(docs[doc_id].alias("id"), docs[text].alias("t"), docs[lang].alias("lang")).where(F.col("lang").isNotNull() & F.col("t").rlike(r"\p{L}"))
    langs = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGS).collect()
    if not langs:
        return {}
    # one scan: hashes below a level that leaves about OVER * DICT_ROWS rows of each language
    part = F.conv(F.substring(id_order(F.col("id")), 1, 8), 16, 10).cast("double") / float(1 << 32)
    level = F.create_map(*[F.lit(v) for r in langs for v in (r["lang"], min(1.0, OVER * DICT_ROWS / r["count"]))])
    some = F.when(F.octet_length("t") <= DICT_BYTES // 8, F.col("t")).otherwise(F.regexp_extract("t", r"(?s)\p{L}.{0,%d}" % (SLICE - 1), 0))
    got = rows.where(part < level[F.col("lang")]).select("id", "lang", some.alias("t"), id_order(F.col("id")).alias("h")).collect()
    out: dict[str, bytes] = {}
    for r in sorted(got, key=lambda r: (r["lang"], r["h"], r["id"])):
        have = out.get(r["lang"], b"")
        if len(have) < DICT_BYTES:
            out[r["lang"]] = (have + letters(r["t"]).encode() + b"\n")[:DICT_BYTES]
    return out


def chooser(dictionaries: dict[str, bytes]):
    langs = sorted(dictionaries)
    sizers = [sizer(dictionaries[x], raw=True, **PARAMS) for x in langs]
    empty = min((s(b"") for s in sizers), default=0)

    def choose(text: str | None) -> tuple[str, float, bool]:
        raw = letters(text or "").encode()
        if not langs or not raw:
            return UND, 0.0, True
        got = [s(raw) for s in sizers]
        best = int(np.argmin(got))
        if len(langs) == 1:
            return langs[0], 1.0, False
        second = min(v for k, v in enumerate(got) if k != best)
        margin = (second - got[best]) / max(1, second - empty)
        return langs[best], float(1 - np.exp2(-1 - 16 * margin)), margin < MARGIN

    return choose


def with_language(docs: DataFrame, dictionaries: dict[str, bytes], text: str = "text") -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)  # MAX_LANGS dictionaries of DICT_BYTES at most
    return add_columns(docs, text, "lang_pred string, score double, rejected boolean", [pa.string(), pa.float64(), pa.bool_()], lambda: chooser(shared.value))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held = F.pmod(id_crc(F.col("doc_id")), F.lit(FOLDS)) == HELD_OUT
    model = fit(docs.where(~held))
    return with_language(docs.select("doc_id", "text"), model).select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")
