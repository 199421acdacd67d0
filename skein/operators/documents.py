"""Document tables: chunk projections, citations, validation, mutations of a store, hooks and policies."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def chunk_metadata(doc: str, index: str, own: Column, given: Column) -> Column:
    """Map of an id, the index, then the chunk's own entries, then the caller's; the later wins."""
    made = F.map_from_arrays(F.array(F.lit("chunk_id"), F.lit("chunk_index")), F.array(F.concat_ws("_chunk_", F.col(doc).cast("string"), F.col(index).cast("string")), F.col(index).cast("string")))
    later = lambda a, b: F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)
    return later(later(made, own), given)


def reference(source: Column, page: Column, slide: Column) -> Column:
    return F.when(page.isNotNull(), F.concat(source, F.lit(" (page "), page.cast("string"), F.lit(")"))).when(slide.isNotNull(), F.concat(source, F.lit(" (slide "), slide.cast("string"), F.lit(")"))).otherwise(source)


def preview(text: Column, size: int = 100) -> Column:
    return F.concat(F.substring(text, 1, size), F.lit("..."))


def problems(tests: dict[str, Column]) -> Column:
    """Names of the tests that a row fails, in order."""
    return F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in tests.items()]))


def validate_url(url: Column, denied: list[str]) -> Column:
    host = F.regexp_extract(url, r"^https?://([^/:?#]+)", 1)
    inside = reduce(lambda a, b: a | b, [(host == d) | F.endswith(host, F.lit(f".{d}")) for d in denied], F.lit(False))
    return problems({"scheme": ~url.rlike("^https?://"), "domain": inside, "length": F.length(url) > 2048})


def upsert(store: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """Rows of the batch instead of the store's rows with the same key; of a key's rows in the batch the last wins."""
    last = batch.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("version")))).filter("_k = 1").drop("_k")
    return store.join(last.select(key), key, "left_anti").unionByName(last)


def delete(store: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return store.join(keys.select(key).distinct(), key, "left_anti")


def with_hooks(df: DataFrame, hooks: list[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Each hook in turn; one that fails while it builds its plan is passed over."""
    from pyspark.errors import PySparkException

    for hook in hooks:
        try:
            df = df.transform(hook)
        except PySparkException:
            continue
    return df


def policy(rows: DataFrame, policies: DataFrame, tier: str, length: str) -> DataFrame:
    """The action of the first policy by priority whose tier and length conditions hold; policies are a small table."""
    met = rows.join(F.broadcast(policies), (F.col("policy_tier").isNull() | (F.col("policy_tier") == F.col(tier))) & (F.col("over_length").isNull() | (F.col(length) > F.col("over_length"))), "left")
    return met.groupBy(*rows.columns).agg(F.max_by("action", "priority").alias("action"))


#: Score of each kind of document.
KINDS = {"pdf": 0.10, "docx": 0.08, "html": 0.05, "md": 0.05, "txt": 0.02}


def metadata_score(kind: Column, headings: Column, links: Column, tables: Column, tokens: Column, has_date: Column, has_language: Column) -> Column:
    base = F.lit(0.01)
    for k, v in KINDS.items():
        base = F.when(kind == k, v).otherwise(base)
    part = lambda c, each, most: F.least(c * each, F.lit(most))
    band = F.when(tokens.between(100, 800), 0.1).when(tokens.between(50, 1500), 0.05).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), base + part(headings, 0.02, 0.1) + part(links, 0.01, 0.05) + part(tables, 0.03, 0.1) + band + F.when(has_date, 0.05).otherwise(0.0) + F.when(has_language, 0.05).otherwise(0.0)))


#: What is suspicious in a file's name, and hosts that are.
ODD_NAMES = ["../", "..\\", "<script", "javascript:"]
ODD_HOSTS = ["localhost", "127.0.0.1", "0.0.0.0"]
#: Kinds by ending, and media types by kind.
KIND_OF = {".pdf": "pdf", ".docx": "docx", ".txt": "text", ".md": "text", ".html": "html"}
MIME_OF = {"application/pdf": "pdf", "text/plain": "text", "text/markdown": "text", "text/html": "html"}


def validated(name: Column, kind: Column, mime: Column, size: Column, most: int, allowed: list[str]) -> dict[str, Column]:
    """errors, warnings and issues of a file, and whether it is valid: by size, ending, media type and name."""
    ending = F.lower(F.regexp_extract(name, r"(\.[^./]+)$", 1))
    base = F.lower(F.regexp_extract(name, r"([^/]*)$", 1))
    of = lambda table, c: F.try_element_at(F.create_map(*[F.lit(x) for item in table.items() for x in item]), c)
    listed = lambda *cases: F.array_compact(F.array(*[F.when(test, text) for test, text in cases]))
    errors = listed(
        (size > most, F.concat(F.lit("File too large: "), size.cast("string"), F.lit(f" bytes (max: {most} bytes)"))),
        ((kind == "pdf") & (ending != ".pdf"), F.concat(F.lit("Invalid PDF file extension: "), ending)),
        ((kind == "docx") & (ending != ".docx"), F.concat(F.lit("Invalid DOCX file extension: "), ending)),
    )
    warnings = listed(
        (~kind.isin(*allowed), F.concat(F.lit("Source type not explicitly allowed: "), kind)),
        (F.coalesce(of(MIME_OF, mime) != of(KIND_OF, ending), F.lit(False)), F.concat(F.lit("MIME/extension mismatch: mime="), mime, F.lit(", ext="), ending)),
    )
    issues = listed((size == 0, F.lit("Empty file")), *[(F.contains(base, F.lit(p)), F.lit(f"Suspicious filename pattern: {p}")) for p in ODD_NAMES])
    return {"errors": errors, "warnings": warnings, "issues": issues, "valid": (F.size(errors) == 0) & (F.size(issues) == 0)}


def mapped(df: DataFrame, column: str, function: Callable, kind: str) -> DataFrame:
    """Rows with ``mapped``, what a Python function makes of a column, in whole Arrow batches; rows on which it fails go."""
    import pyarrow as pa

    columns = [f"c{k}" for k in range(len(df.columns))]
    inner, place = df.toDF(*columns), df.columns.index(column)
    arrow = {"long": pa.int64(), "double": pa.float64(), "string": pa.string()}[kind]

    def run(batches):
        for b in batches:
            kept, values = [], []
            for i, x in enumerate(b.column(place).to_pylist()):
                try:
                    values.append(function(x))
                    kept.append(i)
                except Exception:  # whatever a caller's function raises
                    continue
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(kept, pa.int64())) for c in b.columns), pa.array(values, arrow)], names=[*columns, "mapped"])

    kinds = ", ".join(f"{c} {inner.schema[c].dataType.simpleString()}" for c in columns)
    return inner.mapInArrow(run, f"{kinds}, mapped {kind}").toDF(*df.columns, "mapped")


def in_batches(df: DataFrame, order: list[str], size: int) -> DataFrame:
    """Rows with ``batch``, their batch of ``size`` in this order; numbered by ranges, not in one task."""
    from skein.operators.aggregation import ranked

    placed = ranked(df.withColumn("_all", F.lit(0)), ["_all"], order)
    return placed.withColumn("batch", F.floor(F.col("_i") / size)).drop("_all", "_i", "_n")
