"""Command line: convert, inspect, dump-opf, debug-spine, list-zip over one session."""

from __future__ import annotations

import argparse
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from .functions.audio import resolve_jobs
from .operators import manifest as m
from .operators.speech import engine_options
from .plans.pipeline import convert, inspect, inspect_line
from .session import clean, cut, exists, get_session
from .sources import epub


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quillspark", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("convert", help="narrate e-books into WAV files")
    c.add_argument("input")
    c.add_argument("--out", default="out", help="a folder that all executors share, on any file system")
    c.add_argument("--engine", default="tone")
    c.add_argument("--model-dir", help="folder of the engine's model; by default one named like the engine")
    c.add_argument("--voice", help="name of the voice, with @speed if wanted")
    c.add_argument("--jobs", default="auto")
    c.add_argument("--resume", action="store_true")
    c.add_argument("--by-hash", action="store_true", help="with --resume, narrate only chapters whose text changed")
    c.add_argument("--max-chars", type=int)
    c.add_argument("--sample-rate", type=int)
    for name, head in (("inspect", 5), ("debug-spine", 16), ("list-zip", 50)):
        x = sub.add_parser(name)
        x.add_argument("input")
        x.add_argument("--head", type=int, default=head, help="rows of each book")
    sub.add_parser("dump-opf").add_argument("input")
    return p


def _first(df: DataFrame, order: str, head: int) -> DataFrame:
    """The first rows of each book."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy("book_id").orderBy(order))).where(F.col("_n") <= head)


def _lines(df: DataFrame, *order: str) -> Iterator[Row]:
    """Rows in order, one partition after the other; nothing is gathered."""
    return df.orderBy(*order).toLocalIterator()


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "convert" and args.max_chars is not None and args.max_chars < 1:
        parser().error("--max-chars must be at least 1")
    spark = get_session("quillspark")
    raw = epub.read_epub(spark, args.input, with_text=args.command in ("convert", "inspect"))
    if args.command == "dump-opf":
        for r in _lines(epub.dump_opf(raw), "path"):
            print(f"rootfile: {r.rootfile}\nmanifest_items: {r.manifest_count}\nspine_items: {r.spine_count}\ntitle: {r.title}")
    elif args.command == "debug-spine":
        heads = epub.heads(raw)
        listed = epub.resources(raw).withColumnRenamed("id", "idref")
        rows = _first(epub.spine(raw), "pos", args.head).join(listed, ["book_id", "idref"], "left")
        for r in _lines(heads.join(rows, "book_id", "left"), "book_id", "pos"):
            if not r.pos:
                print(f"spine: {r.spine_count}")
            if r.pos is not None:
                print(f"[{r.pos:02}] idref={r.idref} " + (f"path={r.path} mime={r.mime}" if r.path else "missing in resources"))
    elif args.command == "list-zip":
        for r in _lines(epub.heads(raw).join(_first(epub.resources(raw), "id", args.head), "book_id", "left"), "book_id", "id"):
            if r["_n"] in (None, 1):
                print(f"resources: {r.manifest_count}\nspine: {r.spine_count}")
            if r.id is not None:
                print(f"[{r['_n'] - 1:04}] {r.id} | path={r.path} | mime={r.mime}")
    elif args.command == "inspect":
        # only the chapters shown are read as text and cut into chunks
        counts = epub.heads(raw)
        rows = inspect(epub.chapters(raw, head=args.head).withColumn("chapter_id", F.col("spine_index"))).withColumn("line", inspect_line())
        for r in _lines(counts.join(rows.select("book_id", "spine_index", "line", F.row_number().over(Window.partitionBy("book_id").orderBy("spine_index")).alias("_n")), "book_id", "left"), "book_id", "spine_index"):
            if r["_n"] in (None, 1):
                print(f"title: {r.book_title}\nchapters: {r.n_chapters}")
            if r.line is not None:
                print(r.line)
    else:
        run_convert(spark, raw, args)
        clean(spark)
    return 0


def run_convert(spark: SparkSession, raw: DataFrame, args: argparse.Namespace) -> None:
    """Narrate, print a line per chapter, and write the manifests.

    A worker records each chapter beside its sound file as soon as that is whole, so a run that dies loses nothing
    but the chapters in work; ``--resume`` takes up both manifests and records.
    """
    chapters = cut(epub.chapters(raw), "chapters")
    jobs = resolve_jobs(args.jobs, chapters.count(), spark.sparkContext.defaultParallelism)
    out = args.out if "://" in args.out else os.path.abspath(args.out)
    earlier = files = records = None
    if args.resume and exists(spark, out):
        read = lambda pattern, reader: reader(spark, f"{out}/{pattern}") if exists(spark, f"{out}/{pattern}") else None
        manifests = read("*/manifest.json", m.read_manifests)
        earlier, records = m.flat(manifests) if manifests is not None else None, read("*/progress/*.json", m.read_records)
        files = m.listed_files(spark, out)
    options = engine_options(args.engine, args.model_dir, args.voice, args.sample_rate)
    results, rows = convert(chapters, earlier, files, out, args.engine, jobs, limit=args.max_chars, by_hash=args.by_hash, records=records, **options)
    results = cut(results, "results")
    for r in _lines(results, "book_id", "ordinal"):
        state = f"{r.n_samples / r.sample_rate:.1f}s" if r.status == "done" else r.error
        print(f"[{r.ordinal + 1}/{r.n_chapters} {r.percent}%] {r.status} {r.title} ({state})")
    manifests = m.book_manifests(m.update(rows, results), epub.books(raw))
    m.write_manifest_files(manifests, out).write.format("noop").mode("overwrite").save()
    for r in _lines(epub.heads(raw), "book_id"):
        print(f"parsed: {r.n_chapters} chapters\naudio: {out}/{r.book_id}/chapters\nmanifest: {out}/{r.book_id}/manifest.json")


if __name__ == "__main__":
    raise SystemExit(main())
