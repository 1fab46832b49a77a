"""Processing only new or changed records.

A source is consumed in windows of a monotonic commit sequence. The lower end of a window is the watermark of
the last successful run, the upper end is fixed before anything is read, and a run's output becomes visible by
the very rename that moves the watermark: one commit file names both. A run that dies leaves files that no
commit names; the next run takes the same window again. So nothing is skipped and nothing counted twice.

A planning run follows two sequences at once, the runs of the log and the stored chapter rows: the commit file has
a watermark for each. It writes what is new (the latest entries and the text hashes of its window) as one more
layer of the state and folds only the chapters that its window touches; layers are merged once there are many. A
text is read and hashed in the one run whose window holds its row, never again.

Runs can close late. A commit therefore also keeps the table of runs at or below its watermark that had no outcome
yet; the next window takes along those that have one by then.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .joins import join_small

KEY = ("book_id", "spine_index")
#: Layers of the state that a run reads at most before it merges them into one.
LAYERS = 8
#: Touched chapters up to which they are broadcast to find them in the state; beyond, both are shuffled by chapter.
TOUCHED = 100_000


@dataclass(frozen=True)
class Window:
    """The sequence numbers of one run: above ``low``, up to ``high``."""

    low: int | None
    high: int | None

    @property
    def empty(self) -> bool:
        return self.high is None or (self.low is not None and self.high <= self.low)

    def holds(self, seq: Column) -> Column:
        """True for the rows of this window; null sequence numbers belong to none."""
        if self.empty:
            return F.lit(False)
        inside = seq <= F.lit(self.high)
        if self.low is not None:
            inside = inside & (seq > F.lit(self.low))
        return inside


@dataclass(frozen=True)
class Commit:
    """What one successful run left behind: its watermark and those of further sequences, its outputs, and the layers
    that together are each part of the state."""

    version: int
    high: int | None
    outputs: dict[str, str]
    marks: dict[str, int | None] = field(default_factory=dict)
    layers: dict[str, list[str]] = field(default_factory=dict)


class CommitStore:
    """Commits under one folder of any Hadoop file system.

    ``data/<attempt>/<name>`` holds outputs, ``_commits/<version>.json`` the commit files. A commit file is
    written under another name and renamed without overwriting: of two runs that race for a version one fails.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._Path = jvm.org.apache.hadoop.fs.Path
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._Path(self.root).getFileSystem(conf)
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._Path(self.root).toUri(), conf)
        self._no_options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)

    def _names(self) -> list[str]:
        folder = self._Path(f"{self.root}/_commits")
        if not self._fs.exists(folder):
            return []
        names = sorted(s.getPath().getName() for s in self._fs.listStatus(folder))
        return [n for n in names if n.endswith(".json") and not n.startswith((".", "_"))]

    def commits(self) -> list[Commit]:
        """All commits, oldest first."""
        return [self._read(n) for n in self._names()]

    def _read(self, name: str) -> Commit:
        stream = self._fs.open(self._Path(f"{self.root}/_commits/{name}"))
        try:
            raw = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return Commit(**json.loads(raw))

    def last(self) -> Commit | None:
        """The last commit; no other file is read."""
        names = self._names()
        return self._read(names[-1]) if names else None

    def window(self, high: int | None, mark: str | None = None) -> Window:
        """From the last commit's watermark, or its mark of another sequence, to ``high``, which the caller fixed
        before reading; never backwards."""
        last = self.last()
        low = None if last is None else last.high if mark is None else last.marks.get(mark)
        return Window(low, low if high is None or (low is not None and high < low) else high)

    def write(self, outputs: dict[str, DataFrame]) -> dict[str, str]:
        """Write outputs that no commit names yet; the path of each below the root."""
        attempt = uuid.uuid4().hex
        paths = {name: f"data/{attempt}/{name}" for name in outputs}
        for name, df in outputs.items():
            df.write.parquet(f"{self.root}/{paths[name]}")
        return paths

    def commit(self, window: Window, outputs: dict[str, DataFrame], marks: dict[str, int | None] | None = None, layers: dict[str, list[str]] | None = None) -> Commit:
        """Write the outputs, then publish them together with the watermarks."""
        last = self.last()
        if (last.high if last else None) != window.low:
            raise RuntimeError("another run has moved the watermark; take a new window")
        done = Commit(last.version + 1 if last else 0, window.high if window.high is not None else window.low, self.write(outputs), marks or {}, layers or {})
        self._publish(done)
        return done

    def _publish(self, commit: Commit) -> None:
        source = self._Path(f"{self.root}/_commits/_{uuid.uuid4().hex}.tmp")
        stream = self._fs.create(source, True)
        try:
            stream.write(bytearray(json.dumps(vars(commit)).encode()))
        finally:
            stream.close()
        self._context.rename(source, self._Path(f"{self.root}/_commits/{commit.version:012d}.json"), self._no_options)

    def vacuum(self, older_than_s: float = 7 * 86_400) -> list[str]:
        """Remove what runs that died left behind: attempts that no commit names and that are older than that, so that
        none of a run still at work goes. Returns their names."""
        folder = self._Path(f"{self.root}/data")
        if not self._fs.exists(folder):
            return []
        named = {p.split("/")[1] for c in self.commits() for p in (*c.outputs.values(), *(x for xs in c.layers.values() for x in xs))}
        limit = (time.time() - older_than_s) * 1000
        gone = sorted(s.getPath().getName() for s in self._fs.listStatus(folder) if s.getPath().getName() not in named and s.getModificationTime() <= limit)
        for name in gone:
            self._fs.delete(self._Path(f"{self.root}/data/{name}"), True)
        return gone

    def output(self, commit: Commit, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{commit.outputs[name]}")

    def layer(self, paths: list[str]) -> DataFrame:
        """All layers of one part of the state."""
        return self.spark.read.parquet(*(f"{self.root}/{p}" for p in paths))

    def read(self, name: str) -> DataFrame | None:
        """What all commits wrote under ``name``: exactly once, whatever failed in between."""
        paths = [c.outputs[name] for c in self.commits() if name in c.outputs]
        return self.layer(paths) if paths else None


def process_new(source: DataFrame, seq: str, store: CommitStore, transform: Callable[[DataFrame], DataFrame], name: str = "out", high: int | None = None) -> Commit:
    """Run ``transform`` over the rows of ``source`` whose ``seq`` lies above the watermark, and commit.

    The upper end is ``high``, else the greatest ``seq`` now. Rows with a null ``seq`` were never committed by their
    writer and are not processed. An empty window commits an empty output and leaves the watermark where it was.
    """
    window = store.window(source.agg(F.max(seq)).first()[0] if high is None else high)
    return store.commit(window, {name: transform(source.where(window.holds(F.col(seq))))})


def text_hash(paragraphs: Column) -> Column:
    """Hex SHA-256 of the paragraphs joined by newlines; a null paragraph counts as empty, no array as no paragraph."""
    texts = F.transform(F.coalesce(paragraphs, F.array().cast("array<string>")), lambda p: F.coalesce(p, F.lit("")))
    return F.sha2(F.array_join(texts, "\n"), 256)


def current_chapters(chapters: DataFrame) -> DataFrame:
    """(book_id, spine_index, now) of each chapter's current row; ``now`` has loaded_at, chapter_id and text_hash.

    The row loaded last is current, then that of the greatest chapter_id; a null loaded_at counts as earliest. The
    text is hashed before the shuffle, so only the hash travels. The maximum is associative.
    """
    at = F.coalesce(F.col("loaded_at"), F.lit("0001-01-01").cast("timestamp"))
    now = F.struct(at.alias("loaded_at"), F.col("chapter_id"), F.unhex(text_hash(F.col("paragraphs"))).alias("text_hash"))
    return chapters.select(*KEY, now.alias("now")).groupBy(*KEY).agg(F.max("now").alias("now"))


def fold_entries(entries: DataFrame, runs: DataFrame, window: Window, late: DataFrame | None = None) -> DataFrame:
    """(book_id, spine_index, last): the latest entry of each chapter from the successful runs of the window, and from
    those of ``late`` (run_id), runs at or below the watermark that closed since.

    ``runs`` (run_id, outcome) tells which runs count. The latest is by written_at, then entry_id; the maximum
    is associative, so folding window by window gives what one fold over everything gives.
    """
    ok = runs.where(F.col("outcome") == "ok").select("run_id").distinct()
    last = F.struct(F.coalesce(F.col("written_at"), F.lit("0001-01-01").cast("timestamp")).alias("written_at"), "entry_id", "status", "output", "text_hash")
    new = join_small(entries.where(window.holds(F.col("run_id"))), ok.where(window.holds(F.col("run_id"))), ["run_id"], "left_semi")
    if late is not None:
        older = entries.where(F.col("run_id") <= F.lit(window.low))
        new = new.unionByName(join_small(older, join_small(ok, late, ["run_id"], "left_semi"), ["run_id"], "left_semi"))
    return new.select(*KEY, last.alias("last")).groupBy(*KEY).agg(F.max("last").alias("last"))


def _same(a: DataFrame, b: DataFrame) -> Column:
    """Equal chapters; null keys are chapters like any other."""
    on = F.lit(True)
    for k in KEY:
        on = on & a[k].eqNullSafe(b[k])
    return on


def pending_chapters(texts: DataFrame, entries: DataFrame) -> DataFrame:
    """Chapters of ``texts`` (book_id, spine_index, now) without a settled entry in ``entries`` (book_id, spine_index,
    last): status done, an output, and the hash of the current text. Both may hold several rows of a chapter."""
    now = texts.groupBy(*KEY).agg(F.max("now").alias("now")).select(*KEY, F.col("now.chapter_id").alias("chapter_id"), F.lower(F.hex("now.text_hash")).alias("text_hash"))
    last = entries.groupBy(*KEY).agg(F.max("last").alias("last")).where((F.col("last.status") == "done") & (F.col("last.output") != ""))
    done = last.select(*KEY, F.lower("last.text_hash").alias("_h"))
    return now.join(done, _same(now, done) & (now["text_hash"] == done["_h"]), "left_anti")


def plan_run(chapters: DataFrame, entries: DataFrame, runs: DataFrame, store: CommitStore, high: int | None = None, chapter_high: int | None = None) -> Commit:
    """One incremental run: add the window's entries and texts to the state, list what is left to narrate, commit all.

    ``high`` defaults to the greatest run_id known now and ``chapter_high`` to the greatest chapter_id; what arrives
    later waits for the next run. Chapter rows are stored in the order of their chapter_id and entries in that of
    their run. The commit's outputs are ``pending`` (book_id, spine_index, chapter_id, text_hash), ``open`` (run_id)
    and the layers ``texts`` and ``entries``. Only rows of the window are read, but the state's rows of the chapters
    in it. Null keys are chapters like any other; empty tables give an empty result and a commit all the same.
    """
    last = store.last()
    window = store.window(runs.agg(F.max("run_id")).first()[0] if high is None else high)
    rows = store.window(chapters.agg(F.max("chapter_id")).first()[0] if chapter_high is None else chapter_high, "chapter_id")
    still = store.output(last, "open") if last else None
    new = store.write({"texts": current_chapters(chapters.where(rows.holds(F.col("chapter_id")))), "entries": fold_entries(entries, runs, window, still if last and window.low is not None else None)})
    known = {name: [*(last.layers[name] if last else []), path] for name, path in new.items()}
    texts, found = store.layer(known["texts"]), store.layer(known["entries"])
    if last:
        touched = store.layer([new["texts"]]).select(*KEY).union(store.layer([new["entries"]]).select(*KEY)).distinct()
        if touched.limit(TOUCHED + 1).count() <= TOUCHED:
            touched = F.broadcast(touched)
        before = store.output(last, "pending")
        own = pending_chapters(texts.join(touched, _same(texts, touched), "left_semi"), found.join(touched, _same(found, touched), "left_semi"))
        pending = before.join(touched, _same(before, touched), "left_anti").unionByName(own)
    else:
        pending = pending_chapters(texts, found)
    if len(known["texts"]) > LAYERS:
        merged = store.write({"texts": texts.groupBy(*KEY).agg(F.max("now").alias("now")), "entries": found.groupBy(*KEY).agg(F.max("last").alias("last"))})
        known = {name: [path] for name, path in merged.items()}
    seen = runs.where(window.holds(F.col("run_id")) & F.col("outcome").isNull()).select("run_id")
    if still is not None:
        closed = runs.where(F.col("outcome").isNotNull()).select("run_id")
        seen = seen.union(still.join(closed, "run_id", "left_anti"))
    return store.commit(window, {"pending": pending, "open": seen.distinct()}, {"chapter_id": rows.high}, known)
