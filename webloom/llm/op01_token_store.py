"""Content-addressed store of token ids.

Layout of a store folder (all files are Parquet, written by Spark's committer):

* ``parts`` where part is "chunk": unique chunks (hash, n, payload); files by hash;
* ``recipes``: one row a document in ascending doc_id order: doc_id, file, place
  and start within the file, n_tokens, the addresses and lengths of its chunks in
  order, and (as ``hash``) the Merkle root over those addresses;
* ``manifest``: one row a recipe file: documents, tokens and the Merkle root over
  its recipes in order (a leaf holds doc_id, place, start, n_tokens, the document's
  root and its chunk lengths);
* ``root``: one row: files, documents, tokens and the Merkle root over the files' roots.

Reading checks all of it: chunks against their addresses, recipes against their
roots, recipe files against the manifest, the manifest against the root.  What
doesn't fit raises an error.

A rolling hash over a window of ids cuts each document's id stream, so equal
passages give equal chunks wherever they stand.  A chunk's payload holds its ids
as little-endian u16 where all fit, u32 otherwise; its address is the BLAKE2b-128
of payload and width.

Edge cases: null or empty text is the end id alone; repeated rows and equal texts
share their chunks and each keep a recipe; equal doc_ids are ordered by Merkle
root; null doc_ids come first; an empty table gives an empty store; other columns
are ignored; a document of any length is cut into chunks of at most MAX_IDS ids.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import id_text, map_slices, table, work_folder
from .tokens import ids_bytes, library_encoder

VOCABULARY, END_ID = "word_bpe_49k.json", 1
#: Chunk sizes in ids: least, mean beyond the least (a power of two), most.
MIN_IDS, MEAN_IDS, MAX_IDS = 128, 1024, 8192
WINDOW = 16
#: Hashes a task remembers so as not to send a payload twice; a full set is emptied.
SEEN = 200_000
#: Documents cut and passed on together.
SLICE = 500


def _gear(ids: np.ndarray) -> np.ndarray:
    """A fixed pseudo-random u32 for each id (splitmix64's upper half)."""
    z = ids.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(32)).astype(np.uint32)


_GEARS: list[np.ndarray] = []


def marks_of(ids: np.ndarray, mean: int = MEAN_IDS) -> np.ndarray:
    """Places after which the hash of the last WINDOW ids says "cut"."""
    with np.errstate(over="ignore"):
        if not _GEARS:
            _GEARS.append(_gear(np.arange(1 << 16, dtype=np.uint32)))
        roll = _GEARS[0][ids] if len(ids) and int(ids.max()) < 1 << 16 else _gear(ids)
        span = 1
        while span < WINDOW:  # the sum of the last WINDOW gears, each shifted by its age, by doubling
            later = roll.copy()
            later[span:] += roll[:-span] << np.uint32(span)
            roll, span = later, span * 2
    return np.flatnonzero((roll >> np.uint32(20)) & np.uint32(mean - 1) == 0) + 1


def cut_points(n: int, marks: list[int], least: int = MIN_IDS, most: int = MAX_IDS) -> list[int]:
    """Ends of the chunks of a stream of n ids with these marks; the last end is n."""
    ends, last = [], 0
    for m in marks:
        while m - last > most:
            last += most
            ends.append(last)
        if m - last >= least and m < n:
            ends.append(m)
            last = m
    while n - last > most:
        last += most
        ends.append(last)
    return [*ends, n]


def narrowed(data: bytes) -> bytes:
    """Ids as u16 if all fit, as they are (u32) otherwise."""
    ids = np.frombuffer(data, "<u4")
    return ids.astype("<u2").tobytes() if len(ids) and int(ids.max()) < 1 << 16 else data


def address(payload: bytes, n: int) -> bytes:
    """The address of a chunk of n ids."""
    return blake2b(payload, digest_size=16, person=b"u16" if len(payload) == 2 * n else b"u32").digest()


def merkle_root(leaves: list[bytes]) -> bytes:
    """Pairwise BLAKE2b tree; an odd node is carried up unchanged."""
    level = list(leaves) or [b""]
    while len(level) > 1:
        level = [blake2b(b"".join(level[i : i + 2]), digest_size=16).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


class MerkleFold:
    """merkle_root() of leaves that come one after another, in logarithmic space."""

    def __init__(self):
        self.nodes: list[tuple[int, bytes]] = []

    def add(self, leaf: bytes) -> None:
        height = 0
        while self.nodes and self.nodes[-1][0] == height:
            leaf = blake2b(self.nodes.pop()[1] + leaf, digest_size=16).digest()
            height += 1
        self.nodes.append((height, leaf))

    def root(self) -> bytes:
        out = self.nodes[-1][1] if self.nodes else b""
        for _, node in reversed(self.nodes[:-1]):
            out = blake2b(node + out, digest_size=16).digest()
        return out


ROWS = "part string, hash binary, n int, payload binary, doc_id long, row long, addresses binary, lengths array<int>"
_ARROW = pa.schema(
    [("part", pa.string()), ("hash", pa.binary()), ("n", pa.int32()), ("payload", pa.binary()), ("doc_id", pa.int64()), ("row", pa.int64()), ("addresses", pa.binary()), ("lengths", pa.list_(pa.int32()))]
)


def _cut(vocabulary: str, end_id: int):
    """Batches of doc_id, text, row -> a recipe row for each document, a chunk row for each chunk new to the task."""
    end = ids_bytes([end_id])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, seen = library_encoder(vocabulary), set()
        for batch in batches:
            for first in range(0, batch.num_rows, SLICE):
                part = batch.slice(first, SLICE)
                streams = [b + end for b in encoder.encode_many(part.column("text").to_pylist())]
                ids = np.frombuffer(b"".join(streams), "<u4")
                small = ids.astype("<u2") if len(ids) and int(ids.max()) < 1 << 16 else None
                # Documents are hashed in one array: what the window takes from the document before lies within MIN_IDS, where nothing is cut.
                marks = marks_of(ids)
                ends = np.cumsum([len(b) // 4 for b in streams])
                at = np.searchsorted(marks, ends, side="right")
                chunks, recipes, start, mark = [], [], 0, 0
                for data, doc, row, stop, to in zip(streams, part.column("doc_id").to_pylist(), part.column("row").to_pylist(), ends.tolist(), at.tolist()):
                    addresses, lengths, last = [], [], 0
                    for cut in cut_points(stop - start, (marks[mark:to] - start).tolist()):
                        payload = small[start + last : start + cut].tobytes() if small is not None else narrowed(data[4 * last : 4 * cut])
                        h = address(payload, cut - last)
                        if h not in seen:
                            if len(seen) >= SEEN:
                                seen.clear()
                            seen.add(h)
                            chunks.append((h, cut - last, payload))
                        addresses.append(h)
                        lengths.append(cut - last)
                        last = cut
                    recipes.append((merkle_root(addresses), stop - start, doc, row, b"".join(addresses), lengths))
                    start, mark = stop, to
                c, r = len(chunks), len(recipes)
                columns = [
                    ["chunk"] * c + ["recipe"] * r, [x[0] for x in chunks] + [x[0] for x in recipes], [x[1] for x in chunks] + [x[1] for x in recipes], [x[2] for x in chunks] + [None] * r,
                    [None] * c + [x[2] for x in recipes], [None] * c + [x[3] for x in recipes], [None] * c + [x[4] for x in recipes], [None] * c + [x[5] for x in recipes],
                ]
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(columns, _ARROW)], schema=_ARROW)

    return run


def _keep_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All rows of an address stand side by side in this partition: recipes stay, of equal chunks the first."""
    last = None
    for batch in batches:
        keep = []
        for part, h in zip(batch.column("part").to_pylist(), batch.column("hash").to_pylist()):
            keep.append(part == "recipe" or h != last)
            if part == "chunk":
                last = h
        yield batch.filter(pa.array(keep, pa.bool_()))


def _place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers the sorted recipes of a file and gives each its start there."""
    file, place, start = TaskContext.get().partitionId(), 0, 0
    for batch in batches:
        ends = start + np.cumsum(batch.column("n_tokens").to_numpy())
        n = batch.num_rows
        starts = np.concatenate([[start], ends[:-1]]).astype(np.int64)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, file, np.int32)), pa.array(np.arange(place + 1, place + n + 1)), pa.array(starts[:n])], names=[*batch.schema.names, "file", "place", "start"])
        place, start = place + n, int(ends[-1]) if n else start


def write_store(docs: DataFrame, folder: str, vocabulary: str = VOCABULARY, end_id: int = END_ID) -> None:
    """Tokenize docs (doc_id, text) and write the store described above."""
    spark = docs.sparkSession
    rows = id_text(docs).withColumn("row", F.monotonically_increasing_id()).mapInArrow(_cut(vocabulary, end_id), ROWS)
    # Chunks go by their address; recipes by their row, as all copies of a text have one root.
    by = F.when(F.col("part") == "chunk", F.col("hash")).otherwise(F.col("row").cast("string").cast("binary"))
    rows.repartition(map_slices(spark), by).sortWithinPartitions("part", "hash").mapInArrow(_keep_once, ROWS).write.parquet(f"{folder}/parts")
    order = (F.col("doc_id").asc_nulls_first(), F.col("hash"), F.col("row"))
    recipes = _parts(spark, folder, "recipe").select("doc_id", "row", "hash", F.col("n").cast("long").alias("n_tokens"), "addresses", "lengths")
    recipes = recipes.repartitionByRange(map_slices(spark), *order).sortWithinPartitions(*order)
    placed = f"{recipes.schema.simpleString()[7:-1]},file:int,place:long,start:long".replace(":", " ")
    recipes.mapInArrow(_place, placed).write.option("compression", "zstd").parquet(f"{folder}/recipes")
    file_manifest(spark.read.parquet(f"{folder}/recipes")).write.parquet(f"{folder}/manifest")
    store_root(spark, spark.read.parquet(f"{folder}/manifest")).write.parquet(f"{folder}/root")


def _fold_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (file, n_tokens, leaf) in order, whole files in a partition -> file, documents, tokens, root."""
    names, now, fold, documents, tokens = ["file", "documents", "tokens", "root"], None, MerkleFold(), 0, 0

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([documents], pa.int64()), pa.array([tokens], pa.int64()), pa.array([fold.root()], pa.binary())], names=names)

    for batch in batches:
        for file, n, leaf in zip(*(batch.column(c).to_pylist() for c in ("file", "n_tokens", "leaf"))):
            if file != now:
                if now is not None:
                    yield row()
                now, fold, documents, tokens = file, MerkleFold(), 0, 0
            fold.add(leaf)
            documents, tokens = documents + 1, tokens + n
    if now is not None:
        yield row()


def file_manifest(recipes: DataFrame) -> DataFrame:
    """file, documents, tokens, root of the recipe files; only 32-byte leaves are dealt anew."""
    said = [F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in ("doc_id", "place", "start", "n_tokens")]
    leaf = F.unhex(F.sha2(F.concat_ws("|", *said, F.hex("hash"), F.array_join("lengths", ",")), 256))
    rows = recipes.select("file", "place", "n_tokens", leaf.alias("leaf")).repartition(map_slices(recipes.sparkSession), "file").sortWithinPartitions("file", "place")
    return rows.select("file", "n_tokens", "leaf").mapInArrow(_fold_files, "file int, documents long, tokens long, root binary")


def store_root(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """files, documents, tokens and the root over the files' roots (one row a file reaches the driver)."""
    files, fold = manifest.orderBy("file").collect(), MerkleFold()
    for r in files:
        fold.add(b"%d|%d|%d|" % (r["file"], r["documents"], r["tokens"]) + bytes(r["root"]))
    one = (len(files), sum(r["documents"] for r in files), sum(r["tokens"] for r in files), fold.root())
    return spark.createDataFrame([one], "files long, documents long, tokens long, root binary")


def verify_manifest(spark: SparkSession, folder: str) -> None:
    """Raises ValueError if a recipe file, a recipe's number, order, length or root, or the manifest isn't what was written."""
    manifest = spark.read.parquet(f"{folder}/manifest")
    stated, kept = (df.first() for df in (spark.read.parquet(f"{folder}/root"), store_root(spark, manifest)))
    if stated != kept:
        raise ValueError("the manifest doesn't have the store's root")
    found = file_manifest(spark.read.parquet(f"{folder}/recipes"))
    if not manifest.exceptAll(found).isEmpty() or found.count() != stated["files"]:
        raise ValueError("a recipe file doesn't have its root in the manifest")


def _parts(spark: SparkSession, folder: str, part: str) -> DataFrame:
    return spark.read.schema(ROWS).parquet(f"{folder}/parts").filter(F.col("part") == part)


def _shift_tables() -> np.ndarray:
    """tables[k][j][b]: the effect on a CRC-32 of 2**k zero bytes after it, for byte j of the CRC having value b."""
    poly = 0xEDB88320

    def zero_bit(c):
        return (c >> 1) ^ np.where(c & 1, poly, 0)

    cols = np.uint64(1) << np.arange(32, dtype=np.uint64)
    c = cols.copy()
    for _ in range(8):
        c = zero_bit(c.astype(np.int64)).astype(np.uint64)
    out = []
    for _ in range(48):
        table = np.zeros((4, 256), np.uint64)
        for bit in range(32):
            j, b = divmod(bit, 8)
            table[j, (np.arange(256) >> b) & 1 == 1] ^= c[bit]
        out.append(table)
        c = _apply(table, c)
    return np.stack(out)


def _apply(table: np.ndarray, c: np.ndarray) -> np.ndarray:
    c = c.astype(np.uint64)
    return table[0][(c & np.uint64(255)).astype(np.int64)] ^ table[1][((c >> np.uint64(8)) & np.uint64(255)).astype(np.int64)] ^ table[2][((c >> np.uint64(16)) & np.uint64(255)).astype(np.int64)] ^ table[3][((c >> np.uint64(24)) & np.uint64(255)).astype(np.int64)]


_TABLES: list[np.ndarray] = []


def crc_before(crc: np.ndarray, after: np.ndarray) -> np.ndarray:
    """CRC-32 values moved in front of that many later bytes; the XOR over a stream's pieces is the stream's CRC-32."""
    if not _TABLES:
        _TABLES.append(_shift_tables())
    out, left, k = crc.astype(np.uint64), after.astype(np.int64).copy(), 0
    while left.any():
        odd = (left & 1) == 1
        if odd.any():
            out[odd] = _apply(_TABLES[0][k], out[odd])
        left >>= 1
        k += 1
    return out.astype(np.int64)


def _payload_ids(payload: bytes, n: int) -> np.ndarray:
    return np.frombuffer(payload, "<u2" if len(payload) == 2 * n else "<u4").astype("<u4")


def _check_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        crc = []
        for h, n, p in zip(batch.column("hash").to_pylist(), batch.column("n").to_pylist(), batch.column("payload").to_pylist()):
            if address(p, n) != h:
                raise ValueError("a chunk's ids don't have its address")
            crc.append(zlib.crc32(p if len(p) == 4 * n else _payload_ids(p, n).tobytes()))
        yield pa.RecordBatch.from_arrays([batch.column("hash"), pa.array(crc, pa.int64())], names=["hash", "crc"])


@F.pandas_udf(T.BooleanType())
def _root_matches(root: pd.Series, addresses: pd.Series) -> pd.Series:
    return pd.Series([merkle_root([a[i : i + 16] for i in range(0, len(a), 16)]) == r for r, a in zip(root, addresses)], dtype="bool")


@F.pandas_udf(T.LongType())
def _moved(crc: pd.Series, after: pd.Series) -> pd.Series:
    return pd.Series(crc_before(crc.to_numpy(), after.to_numpy()))


def read_digests(spark: SparkSession, folder: str) -> DataFrame:
    """Per document from the files: doc_id, start over all documents, n_tokens, ids_crc32, n_chunks, verified.

    Each stored chunk is read once, checked against its address and reduced to
    its CRC; documents combine the CRCs of their recipes, so payloads aren't shuffled.
    A row whose recipe or chunks don't fit fails the query.
    """
    verify_manifest(spark, folder)
    recipes = spark.read.parquet(f"{folder}/recipes")
    manifest = spark.read.parquet(f"{folder}/manifest")  # a row for each recipe file
    before = manifest.select("file", (F.sum("tokens").over(Window.orderBy("file")) - F.col("tokens")).alias("base"))
    places = F.expr("transform(lengths, (n, i) -> named_struct('hash', substring(addresses, 16 * i + 1, 16), 'after', 4 * (n_tokens - aggregate(slice(lengths, 1, i + 1), 0L, (a, x) -> a + x))))")
    parts = recipes.select("file", "place", F.explode(places).alias("c")).select("file", "place", "c.hash", "c.after")
    crcs = _parts(spark, folder, "chunk").select("hash", "n", "payload").mapInArrow(_check_chunks, "hash binary, crc long")
    joined = parts.join(crcs, "hash").select("file", "place", _moved("crc", "after").alias("moved"))
    crc = joined.groupBy("file", "place").agg(F.bit_xor("moved").alias("ids_crc32"), F.count("*").alias("found"))
    docs = recipes.select("file", "place", "doc_id", "start", "n_tokens", F.size("lengths").alias("n_chunks"), _root_matches("hash", "addresses").alias("root_ok"))
    whole = F.col("root_ok") & F.coalesce(F.col("found") == F.col("n_chunks"), F.lit(False))
    lost = F.raise_error(F.lit("a document's chunks don't have its root or are missing")).cast("boolean")
    return (docs.join(crc, ["file", "place"], "left").join(F.broadcast(before), "file")
        .select("doc_id", (F.col("start") + F.col("base")).alias("start"), "n_tokens", "ids_crc32", "n_chunks", F.when(whole, F.lit(True)).otherwise(lost).alias("verified")))


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Documents rebuilt from the files: doc_id, file, place, ids (array of long)."""
    places = F.expr("transform(lengths, (n, i) -> named_struct('k', i, 'hash', substring(addresses, 16 * i + 1, 16)))")
    parts = spark.read.parquet(f"{folder}/recipes").select("doc_id", "file", "place", F.explode(places).alias("c")).select("doc_id", "file", "place", "c.k", "c.hash")

    @F.pandas_udf("array<long>")
    def ids(payload: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([_payload_ids(p, k).astype("int64") for p, k in zip(payload, n)])

    chunks = _parts(spark, folder, "chunk").withColumn("ids", ids("payload", "n")).select("hash", "ids")
    return parts.join(chunks, "hash").groupBy("doc_id", "file", "place").agg(F.flatten(F.expr("transform(sort_array(collect_list(struct(k, ids))), x -> x.ids)")).alias("ids"))


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_folder(spark, "token-store")
    write_store(table(spark, sf_dir, "documents"), folder)
    return read_digests(spark, folder)
