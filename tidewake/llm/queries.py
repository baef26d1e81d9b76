"""The queries of this subpackage: each applies its operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession



def _of(module: str, name: str, table: str = "documents") -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        from importlib import import_module

        return getattr(import_module(f"{__package__}.{module}"), name)(spark.read.parquet(f"{sf_dir}/{table}.parquet"))

    query.__name__ = name
    return query


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {
        name: _of(module, name)
        for module, name in (
            ("secrets", "op1_secrets"),
            ("passages", "op2_passages"),
            ("pii", "op3_pii"),
            ("packing", "op4_packing"),
            ("bpe", "op5_bpe"),
            ("simhash", "op6_simhash"),
            ("quality", "op7_quality"),
            ("winnow", "op8_winnow"),
            ("tokenfile", "op10_tokenfile"),
        )
    }
    out["op9_urls"] = _of("urls", "op9_urls", "pages")
    return out


def oracle_sql() -> dict[str, str]:
    """The other results can't be told in SQL alone (see the README); tests hold them against brute force."""
    from .quality import oracle_sql as quality
    from .secrets import oracle_sql as secrets
    from .urls import oracle_sql as urls

    return {"op1_secrets": secrets(), "op7_quality": quality(), "op9_urls": urls()}
