"""Substring dedup by super-k-mer partitioning.

A window is ``WINDOW`` consecutive words of a text. Its minimiser is the least hash among the runs of
``RUN`` words inside it, so equal windows have equal minimisers. Consecutive windows that share a
minimiser travel as one packed string to the minimiser's bucket, where windows are sorted, which
brings equal ones together.

What never needs to travel does not: of documents with equal words one stands for all, and super-k-mers
go only where their minimiser occurs in another document too. A minimiser of over ``HOT_BUCKET``
documents is a hot bucket: there equal super-k-mers are summed before the shuffle, and the windows
of those that are left are spread by their own 128-bit digest instead.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kveil.llm.common import col, map_arrow, table
from kveil.session import cut_lineage

WINDOW = 50
RUN = 10
HOT_BUCKET = 500
LONGEST = 1024  # windows in one super-k-mer


def minimisers(words: list[bytes]) -> np.ndarray:
    """The minimiser of each window of a text."""
    n = len(words)
    if n < WINDOW:
        return np.empty(0, dtype=np.uint64)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=n)
    runs = np.zeros(n - RUN + 1, dtype=np.uint64)
    for k in range(RUN):
        runs = runs * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + len(runs)]
    runs ^= runs >> np.uint64(31)
    runs *= np.uint64(0xBF58476D1CE4E5B9)
    runs ^= runs >> np.uint64(29)
    width, reach = WINDOW - RUN + 1, 1
    least = runs
    while reach * 2 <= width:  # minima over 2, 4, 8, ... runs
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    rest = width - reach
    return np.minimum(least[: len(least) - rest], least[rest:]) if rest else least


def super_kmers(least: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(minimiser, first window, windows) of each run of windows with one minimiser."""
    cuts = np.flatnonzero(least[1:] != least[:-1]) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(least)]):
        for s in range(a, b, LONGEST):
            yield int(least[s]), s, min(LONGEST, b - s)


def survey_worker(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number and digest of a text's words, and its distinct minimisers."""
    for batch in batches:
        n, digest, found = [], [], []
        for text in batch.column("text"):
            words = (text.as_py() or b"").split()
            n.append(len(words))
            digest.append(hashlib.sha256(b" ".join(words)).digest())
            found.append(np.unique(minimisers(words)).view(np.int64))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("id"),
                pa.array(n, pa.int64()),
                pa.array(digest, pa.binary()),
                pa.array(found, pa.list_(pa.int64())),
            ],
            names=["id", "n_words", "digest", "minimisers"],
        )


def packed_rows(batch: pa.RecordBatch, hot: bool) -> Iterator[tuple]:
    """(row, minimiser, first window, windows, packed string) of a batch's shared super-k-mers."""
    for row, (text, shared) in enumerate(zip(batch.column("text"), batch.column("shared"))):
        words = (text.as_py() or b"").split()
        wanted = {s["minimiser"] & 0xFFFFFFFFFFFFFFFF for s in shared.as_py() if s["hot"] == hot}
        if not wanted:
            continue
        for least, start, many in super_kmers(minimisers(words)):
            if least in wanted:
                yield row, least, start, many, b" ".join(words[start : start + many + WINDOW - 1])


def pack_worker(hot: bool, texts: bool):
    """Super-k-mers of hot or of other buckets, with their packed strings or with digests of them."""

    def batch_of(source: pa.RecordBatch, rows: list[tuple]) -> pa.RecordBatch:
        at, least, start, many, packed = zip(*rows)
        what = packed if texts else [hashlib.blake2b(p, digest_size=16).digest() for p in packed]
        return pa.RecordBatch.from_arrays(
            [
                source.column("id").take(pa.array(at, pa.int32())),
                pa.array(np.array(least, dtype=np.uint64).view(np.int64)),
                pa.array(start, pa.int32()),
                pa.array(many, pa.int32()),
                pa.array(what, pa.binary()),
            ],
            names=["id", "minimiser", "start", "windows", "packed"],
        )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for row in packed_rows(batch, hot):
                rows.append(row)
                if len(rows) >= 20_000:
                    yield batch_of(batch, rows)
                    rows = []
            if rows:
                yield batch_of(batch, rows)

    return work


def windows_of(packed: bytes) -> list[bytes]:
    """The windows in a packed string."""
    ends = np.flatnonzero(np.frombuffer(packed, dtype=np.uint8) == 32).tolist()
    starts = [0, *(e + 1 for e in ends)]
    ends.append(len(packed))
    return [packed[a:b] for a, b in zip(starts, ends[WINDOW - 1 :])]


def stretches(start: int, windows: list[int]) -> Iterator[tuple[int, int]]:
    """The stretches of words, end exclusive, that windows of one super-k-mer cover."""
    first = before = None
    for w in windows:
        if before is not None and w > before + WINDOW:
            yield start + first, start + before + WINDOW
            first = None
        first = w if first is None else first
        before = w
    if before is not None:
        yield start + first, start + before + WINDOW


def bucket_stretches(rows: list[tuple]) -> Iterator[tuple]:
    """(id, from, to) in one bucket: words of windows that also start in a document of a smaller id."""
    owners: dict[bytes, object] = {}
    for who, _, packed in rows:
        if packed not in owners or who < owners[packed]:
            owners[packed] = who
    cut = {packed: windows_of(packed) for packed in owners}
    ordered = sorted((w, owners[packed]) for packed, ws in cut.items() for w in ws)
    first: dict[bytes, object] = {}
    for w, who in ordered:  # of equal windows the one of the smallest id comes first
        first.setdefault(w, who)
    for who, start, packed in rows:
        for a, b in stretches(start, [i for i, w in enumerate(cut[packed]) if first[w] < who]):
            yield who, a, b


def bucket_worker(kind: pa.DataType):
    """Reads buckets one after another from rows sorted by minimiser; none exceeds the hot bound."""

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        who, a, b = zip(*rows)
        return pa.RecordBatch.from_arrays(
            [pa.array(who, kind), pa.array(a, pa.int32()), pa.array(b, pa.int32())], names=["id", "from", "to"]
        )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        last = None
        out: list[tuple] = []
        for batch in batches:
            columns = [batch.column(n).to_pylist() for n in ("minimiser", "id", "start", "packed")]
            for least, *row in zip(*columns):
                if least != last:
                    if len(held) > 1:
                        out += bucket_stretches(held)
                    held, last = [], least
                held.append(tuple(row))
                if len(out) > 50_000:
                    yield batch_of(out)
                    out = []
        if len(held) > 1:
            out += bucket_stretches(held)
        if out:
            yield batch_of(out)

    return work


def window_worker(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per window of packed strings: digest of the string, number and digest of the window."""
    for batch in batches:
        for row, packed in enumerate(batch.column("packed")):
            text = packed.as_py()
            digests = [hashlib.blake2b(w, digest_size=16).digest() for w in windows_of(text)]
            key = hashlib.blake2b(text, digest_size=16).digest()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([key] * len(digests), pa.binary()),
                    pa.array(range(len(digests)), pa.int32()),
                    pa.array(digests, pa.binary()),
                    batch.column("first").take(pa.array([row] * len(digests), pa.int32())),
                ],
                names=["packed", "window", "digest", "first"],
            )


def hot_worker(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches of super-k-mers of hot buckets: all windows if a smaller id has the same, else those listed."""
    for batch in batches:
        rows, a, b = [], [], []
        columns = [batch.column(n).to_pylist() for n in ("start", "windows", "repeated", "listed")]
        for row, (start, many, repeated, listed) in enumerate(zip(*columns)):
            for x, y in stretches(start, list(range(many)) if repeated else sorted(listed or [])):
                rows.append(row)
                a.append(x)
                b.append(y)
        yield pa.RecordBatch.from_arrays(
            [batch.column("id").take(pa.array(rows, pa.int32())), pa.array(a, pa.int32()), pa.array(b, pa.int32())],
            names=["id", "from", "to"],
        )


def remove_worker(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words that stay, joined by one space."""
    for batch in batches:
        removed, left = [], []
        for text, cuts in zip(batch.column("text"), batch.column("cuts")):
            words = text.as_py().split()
            stay = np.ones(len(words), dtype=bool)
            for cut in cuts.as_py():
                stay[cut["from"] : cut["to"]] = False
            removed.append(int(len(words) - stay.sum()))
            left.append(b" ".join([w for w, s in zip(words, stay.tolist()) if s]))
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array(removed, pa.int64()), pa.array(left, pa.binary())],
            names=["id", "n_removed", "kept"],
        )


def repeated_stretches(affected: DataFrame, kind: str) -> DataFrame:
    """(id, from, to) of all words to remove from texts with shared minimisers."""
    spark = affected.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shape = f"id {kind}, minimiser long, start int, windows int, packed binary"
    cuts = f"id {kind}, from int, to int"
    arrow_kind = affected.select("id").limit(0).toArrow().schema.field("id").type

    few = map_arrow(affected, pack_worker(hot=False, texts=True), shape)
    few = few.select("minimiser", "id", "start", "packed").repartition(tasks, "minimiser")
    out = map_arrow(few.sortWithinPartitions("minimiser"), bucket_worker(arrow_kind), cuts)

    many = affected.filter(F.exists("shared", lambda s: s["hot"]))
    strings = map_arrow(many, pack_worker(hot=True, texts=True), shape)
    strings = strings.groupBy("packed").agg(F.min("id").alias("first"))
    windows = cut_lineage(
        map_arrow(strings, window_worker, f"packed binary, window int, digest binary, first {kind}")
    )
    least = windows.groupBy("digest").agg(F.min("first").alias("least"), F.max("first").alias("most"))
    # written out, so that both sides of the join are plain shuffles and Spark can split a hot digest
    least = cut_lineage(least.filter("least < most").select("digest", "least"))
    beaten = windows.join(least, "digest").filter("least < first").groupBy("packed")
    listed = beaten.agg(F.collect_list("window").alias("listed"))
    firsts = windows.filter("window = 0").select("packed", "first")
    places = map_arrow(many, pack_worker(hot=True, texts=False), shape)
    found = places.join(firsts, "packed").join(listed, "packed", "left")
    found = found.select("id", "start", "windows", (F.col("first") < F.col("id")).alias("repeated"), "listed")
    return out.union(map_arrow(found.filter("repeated OR listed IS NOT NULL"), hot_worker, cuts))


def substring_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_removed, kept_sha256, kept) per row; kept is the text that stays, null if unchanged.

    A word goes when a window of ``WINDOW`` words around it also starts in a document of a smaller id,
    judged on the input. Ids should be unique; rows repeated with their id count as one document and
    get one answer each. A row with a null id is left as it is and takes nothing from others. Null and
    short texts lose nothing. An empty table gives an empty table. No other column is read.
    """
    rows = df.select(col(id_col).alias("id"), col(text_col).cast("binary").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    surveyed = cut_lineage(
        map_arrow(rows, survey_worker, f"id {kind}, n_words long, digest binary, minimisers array<long>")
    )
    long = surveyed.filter(f"id IS NOT NULL AND n_words >= {WINDOW}")
    groups = cut_lineage(long.groupBy("digest").agg(F.min("id").alias("keeper")))
    keepers = long.join(groups.select(F.col("keeper").alias("id"), "digest"), ["id", "digest"], "left_semi")
    places = keepers.select("id", F.explode("minimisers").alias("minimiser")).distinct()
    sizes = places.groupBy("minimiser").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = places.join(sizes.select("minimiser", (F.col("n") > HOT_BUCKET).alias("hot")), "minimiser")
    lists = shared.groupBy("id").agg(F.collect_list(F.struct("minimiser", "hot")).alias("shared"))
    affected = cut_lineage(rows.join(lists, "id"))

    cuts = repeated_stretches(affected, kind).groupBy("id").agg(F.collect_list(F.struct("from", "to")).alias("cuts"))
    changed = affected.select("id", "text").dropDuplicates(["id"]).join(cuts, "id")
    changed = map_arrow(changed, remove_worker, f"id {kind}, n_removed long, kept binary")
    changed = changed.withColumn("kept", F.decode("kept", "UTF-8"))

    whole = surveyed.select("id", "n_words", "digest").join(groups, "digest", "left")
    whole = whole.select("id", "n_words", "digest", (F.col("keeper") < F.col("id")).alias("copy"))
    copy = F.coalesce("copy", F.lit(False))
    found = whole.join(changed, "id", "left")
    left = F.when(copy, F.lit("")).otherwise(F.col("kept"))
    return found.select(
        "id",
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long"))).alias("n_removed"),
        F.coalesce(F.sha2(left, 256), F.lower(F.hex("digest"))).alias("kept_sha256"),
        left.alias("kept"),
    )


def op7_super_kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_removed", "kept_sha256")
