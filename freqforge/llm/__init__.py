"""Training-data operators. Nothing outside this folder imports it.

``queries()`` and ``oracle_sql()`` are what ``__spark_entry__`` adds when the
folder is there.
"""
from importlib import import_module

#: module of each registered query, in the order of the operators
MODULES = {
    "op1_sharding": "sharding",
    "op2_secret_scans": "secrets",
    "op3_quality_classifier": "quality",
    "op4_ngram_jaccard_join": "jaccard",
    "op5_document_fingerprints": "fingerprint",
    "op6_best_fit_packing": "packing",
    "op7_mixing": "mixing",
    "op8_license_scans": "licenses",
    "op9_embedding_near_dedup": "embed",
    "op10_language_id": "langid",
}


def queries():
    out = {name: import_module(f"{__name__}.{mod}").query for name, mod in MODULES.items()}
    import corpus_pipeline

    return out | {"pipeline": corpus_pipeline.run}


def oracle_sql():
    out = {}
    for name, mod in MODULES.items():
        sql = getattr(import_module(f"{__name__}.{mod}"), "ORACLE_SQL", None)
        if sql:
            out[name] = sql
    return out
