"""Jobs over a folder of tables, each as a plan that is written to a new folder (API15):

    python -m quillspark JOB TABLES OUT [--files PATH] [--owner ID] [--chapters N]

``TABLES`` holds Parquet tables (documents, chunks, pages, vectors as the job reads them).
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import audit, chunking, vectors
from quillspark.plans.ingest import ingest

SPACE = ("hash", "trigrams", 1)


def reindex(tables, args) -> dict[str, DataFrame]:
    """Chunks of all documents' pages anew, with what that changes."""
    pages = tables("pages")
    fresh = chunking.chunk_structured(pages)
    return {"chunks": fresh, "report": audit.reindex_report(tables("chunks"), fresh), "cleaning": chunking.cleaning_audit(pages)}


def reembed(tables, args) -> dict[str, DataFrame]:
    """Vectors of the chunks that lack a current one."""
    fresh = vectors.embedded(vectors.needing_vectors(tables("chunks"), tables("vectors"), SPACE), vectors.retrying(vectors.hashing_embedder()), SPACE)
    return {"vectors": vectors.replaced(tables("vectors"), fresh, tables("chunks"))}


def rebuild(tables, args) -> dict[str, DataFrame]:
    """Vectors of all chunks anew."""
    return {"vectors": vectors.embedded(tables("chunks"), vectors.retrying(vectors.hashing_embedder()), SPACE)}


def load(tables, args) -> dict[str, DataFrame]:
    """Files as new documents and chunks, with a report."""
    return ingest(SparkSession.active(), args.files, args.owner, tables("documents"))


def inspect(tables, args) -> dict[str, DataFrame]:
    """Chapters of the stored chunks, and chunks whose page is before one named ahead of them."""
    chunks = tables("chunks")
    return {"chapters": audit.chapter_summary(chunks.withColumn("embedded", F.lit(1))), "order": audit.order_violations(chunks)}


def repair_structure(tables, args) -> dict[str, DataFrame]:
    """Chapters that only stay or step up by one."""
    chunks = tables("chunks")
    fixed = audit.repaired_chapters(chunks, chunks.select("document_id").distinct().withColumn("n", F.lit(args.chapters)))
    return {"chunks": chunks.drop("chapter", "section").join(fixed, ["document_id", "chunk_index"])}


def repair_noise(tables, args) -> dict[str, DataFrame]:
    """Stored chunks without their noise lines."""
    return {"chunks": chunking.without_noise_lines(tables("chunks"))}


JOBS = {"reindex": reindex, "reembed": reembed, "rebuild": rebuild, "import": load, "audit": inspect, "repair-structure": repair_structure, "repair-noise": repair_noise}


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="quillspark", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("job", choices=JOBS)
    parser.add_argument("tables")
    parser.add_argument("out")
    parser.add_argument("--files")
    parser.add_argument("--owner", type=int, default=1)
    parser.add_argument("--chapters", type=int, default=8)
    args = parser.parse_args(arguments)
    spark = SparkSession.builder.getOrCreate()
    for name, df in JOBS[args.job](lambda t: spark.read.parquet(f"{args.tables}/{t}"), args).items():
        df.write.parquet(f"{args.out}/{name}")


if __name__ == "__main__":
    main()
