"""Report files: nested JSON and Markdown, one folder per dataset and use case."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from plumbline.functions.text import gather

KEY = ["dataset", "use_case"]
# Columns that put the rows of a table in order, where it has them.
ORDER = ("tier_no", "section", "seq", "rank", "position", "req_no", "column", "feature", "kind")


def nested_json(uses: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """(dataset, use_case, json): all result tables of a run in one document.

    Tables are small by nature: a row per column, requirement or model.
    """
    out = uses.select(*KEY)
    for name, table in tables.items():
        key = [c for c in KEY if c in table.columns]
        rest = [c for c in table.columns if c not in key]
        order = [c for c in ORDER if c in rest] or rest[:1]
        grouped = table.groupBy(*key).agg(gather(F.struct(*order), F.struct(*rest)).alias(name))
        out = out.join(F.broadcast(grouped), key, "left")
    document = F.to_json(F.struct("*"), {"pretty": "true", "ignoreNullFields": "false"})
    return out.select(*KEY, document.alias("json"))


def write_documents(documents: DataFrame, text: str, folder: str) -> None:
    """Write one text per (dataset, use_case) below the folder."""
    documents.select(*KEY, F.col(text).alias("value")).write.mode("error").partitionBy(*KEY).text(folder)


def save_reports(
    uses: DataFrame, tables: dict[str, DataFrame], markdown: DataFrame, folder: str, stamp: str
) -> DataFrame:
    """Write JSON and Markdown reports; returns (dataset, use_case, kind, path)."""
    folders = {
        "json": f"{folder.rstrip('/')}/report_{stamp}.json",
        "markdown": f"{folder.rstrip('/')}/report_{stamp}.md",
    }
    write_documents(nested_json(uses, tables), "json", folders["json"])
    write_documents(markdown, "markdown", folders["markdown"])
    kinds = F.explode(F.create_map(*[F.lit(x) for pair in folders.items() for x in pair]))
    return uses.select(*KEY, kinds.alias("kind", "root")).select(
        *KEY,
        "kind",
        F.concat("root", F.lit("/dataset="), "dataset", F.lit("/use_case="), "use_case").alias("path"),
    )
