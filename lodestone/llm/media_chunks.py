"""Media columns in content-defined chunks: each distinct chunk is stored once, ordered chunk lists give the media back."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import discarded, documents, new_path, shuffles_dropped, slices, whole_text, written

PAD, RATE = 64, 8000
#: A cut falls where these bits of the rolling gear hash are zero (1 in 4096 places), not within LEAST bytes of the last, and
#: at the latest MOST bytes after it.
CUT_BITS, LEAST, MOST = 12, 1024, 32_768
#: One 32-bit number for each byte value, from the digest of the value.
GEAR = np.array([int.from_bytes(hashlib.sha256(bytes([b])).digest()[:4], "little") for b in range(256)], np.uint32)
HEADER = 44
#: Zstandard level of stored and shuffled bytes.
LEVEL = 6
#: Payloads are shuffled and stored in so many rounds, by the digest of the text: what is shuffled at a time is that part of them.
ROUNDS = 2


def padded(raw: bytes) -> bytes:
    """The bytes and zeros up to a positive multiple of 64."""
    return raw + bytes(-len(raw) % PAD if raw else PAD)


def media_of(payload: bytes) -> bytes:
    """The payload as the 8-bit samples of a mono WAV file."""
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload)) + payload


def payload_of(media: bytes) -> bytes:
    """The samples of such a file."""
    if media[:4] != b"RIFF" or media[36:40] != b"data" or struct.unpack("<I", media[40:44])[0] != len(media) - HEADER:
        raise ValueError("not a media file of this module")
    return media[HEADER:]


def gear_cuts(data: bytes) -> list[int]:
    """Ends of the chunks. The hash at a place is the sum of the gear numbers of the bytes before it, each shifted by its
    distance; its lowest CUT_BITS bits depend on the last CUT_BITS bytes, so doubling the window four times gives all of them."""
    n = len(data)
    if n <= LEAST:
        return [n] if n else []
    h = GEAR[np.frombuffer(data, np.uint8)].astype(np.uint16)
    for k in range(4):
        w = 1 << k
        h[w:] += h[:-w] << np.uint16(w)
    wanted = np.flatnonzero((h & np.uint16((1 << CUT_BITS) - 1)) == 0) + 1
    cuts, last = [], 0
    for c in wanted.tolist():
        while c - last > MOST:
            last += MOST
            cuts.append(last)
        if c - last >= LEAST and c < n:
            cuts.append(c)
            last = c
    while n - last > MOST:
        last += MOST
        cuts.append(last)
    return [*cuts, n]


def chunks(media: bytes) -> list[bytes]:
    """The header, then the content-defined chunks of the samples."""
    body = media[HEADER:]
    ends = gear_cuts(body)
    return [media[:HEADER], *(body[a:b] for a, b in zip([0, *ends], ends))]


def digest(chunk: bytes) -> bytes:
    return hashlib.sha256(chunk).digest()[:16]


MANIFEST = "doc_id long, n_bytes long, media_sha256 string, digests array<binary>, lengths array<int>"


def manifests(docs: DataFrame) -> DataFrame:
    """For each row of docs its media's digest, and the digests and lengths of its chunks in order; no payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            n, sha, lists, lengths = [], [], [], []
            for text in b.column("text").to_pylist():
                raw = text.encode()
                media = media_of(padded(raw))
                own = chunks(media)
                n.append(len(raw))
                sha.append(hashlib.sha256(media).hexdigest())
                lists.append([digest(c) for c in own])
                lengths.append([len(c) for c in own])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(sha), pa.array(lists, pa.list_(pa.binary())), pa.array(lengths, pa.list_(pa.int32()))], ["doc_id", "n_bytes", "media_sha256", "digests", "lengths"])

    return docs.select(F.col("doc_id").cast("long"), whole_text().alias("text")).mapInArrow(run, MANIFEST)


def packed(docs: DataFrame) -> DataFrame:
    """doc_id, media_sha256, z: the compressed media of each row, small enough to be shuffled once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=LEVEL)
        for b in slices(batches):
            media = [media_of(padded(t.encode())) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([hashlib.sha256(m).hexdigest() for m in media]), pa.array([squeeze.compress(m) for m in media], pa.binary())], ["doc_id", "media_sha256", "z"])

    return docs.select(F.col("doc_id").cast("long"), whole_text().alias("text")).mapInArrow(run, "doc_id long, media_sha256 string, z binary")


STORE = "kind string, media_sha256 string, digest binary, data binary, digests array<binary>, lengths array<int>, complete boolean"


def store_media(docs: DataFrame, listed: DataFrame) -> DataFrame:
    """The chunk store of docs, written; listed are their manifests.

    A row of kind 'own' for each distinct media: its chunk list and, compressed together in order, the chunks that no other
    media holds (complete: these are all). A row of kind 'shared' for each chunk that several media hold, once. Which chunks
    are shared is found by joins of digests alone; of the payloads one copy of each media is shuffled once, compressed.
    """
    media = written(listed.groupBy("media_sha256").agg(F.min("doc_id").alias("doc_id"), F.first("digests").alias("digests")), "media")
    # the header, which all media of one length have, stays with each media: 44 bytes aren't worth a fetch
    each = media.select("media_sha256", F.explode(F.array_distinct(F.slice("digests", 2, 1 << 30))).alias("digest"))
    shared = written(each.groupBy("digest").agg(F.count("*").alias("n"), F.min("media_sha256").alias("keeper")).filter("n > 1").select("digest", "keeper"), "shared")
    held = each.join(shared, "digest").select("media_sha256", F.struct("digest", (F.col("keeper") == F.col("media_sha256")).alias("keeps")).alias("role"))
    held_roles = written(held.groupBy("media_sha256").agg(F.collect_list("role").alias("roles")), "roles")
    roles = media.select("doc_id", "media_sha256").join(held_roles, "media_sha256", "left")
    # null ids meet under a number, so that the join's keys are columns and what follows needs no other shuffle
    key = F.coalesce("doc_id", F.lit(-(1 << 63))).alias("key")
    roles = roles.select(key, "media_sha256", "roles")
    turn = lambda k: F.pmod(F.xxhash64(whole_text()), F.lit(ROUNDS)) == k

    def source(k: int) -> DataFrame:
        # repeated rows of an id and text lie together after the join: one of them is kept
        return packed(docs.filter(turn(k))).select(key, "media_sha256", "z").join(roles, ["key", "media_sha256"]).dropDuplicates(["key", "media_sha256"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze, open_ = zstandard.ZstdCompressor(level=LEVEL), zstandard.ZstdDecompressor()
        schema = pa.schema([("kind", pa.string()), ("media_sha256", pa.string()), ("digest", pa.binary()), ("data", pa.binary()), ("digests", pa.list_(pa.binary())), ("lengths", pa.list_(pa.int32())), ("complete", pa.bool_())])
        for b in slices(batches, "z", 1 << 20):
            rows = []
            for sha, z, roles in zip(b.column("media_sha256").to_pylist(), b.column("z").to_pylist(), b.column("roles").to_pylist()):
                keeps = {r["digest"]: r["keeps"] for r in roles or []}
                parts = chunks(open_.decompress(z))
                digests, own = [digest(c) for c in parts], []
                for d, c in dict(zip(digests, parts)).items():  # each once, where it first stands
                    if d not in keeps:
                        own.append(c)
                    elif keeps[d]:
                        rows.append(("shared", None, d, squeeze.compress(c), None, None, None))
                rows.append(("own", sha, None, squeeze.compress(b"".join(own)), digests, [len(c) for c in parts], not keeps))
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)

    path = new_path(docs.sparkSession, "store")
    for k in range(ROUNDS):
        source(k).select("media_sha256", "z", "roles").mapInArrow(run, STORE).write.mode("append").option("compression", "zstd").parquet(path, partitionBy=["kind"])
    discarded(media, shared, held_roles)
    store = docs.sparkSession.read.schema(STORE).parquet(path)
    store.written_path = path
    return store


FEATURES = "media_sha256 string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, feature string"
_schema = pa.schema([("media_sha256", pa.string()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("feature", pa.string())])


def rebuilt(store: DataFrame) -> DataFrame:
    """The features of each media of the store, from its bytes alone. Complete media need no shuffle; of the others the own
    bytes and the shared chunks that they ask for meet by media."""
    own = store.filter("kind = 'own'")
    some = own.filter("not complete")
    asked = some.select("media_sha256", F.explode(F.array_distinct(F.slice("digests", 2, 1 << 30))).alias("digest"))
    kept = store.filter("kind = 'shared'").select("digest", "data").dropDuplicates(["digest"])
    parts = asked.join(kept, "digest").select("media_sha256", "digest", "data", F.lit(None).cast("array<binary>").alias("digests"), F.lit(None).cast("array<int>").alias("lengths"))
    rows = some.select("media_sha256", "digest", "data", "digests", "lengths").unionByName(parts)
    first = lambda c: F.first(c, ignorenulls=True).alias(c)
    mixed = rows.groupBy("media_sha256").agg(F.collect_list(F.struct("digest", "data")).alias("parts"), first("digests"), first("lengths"))
    whole = own.filter("complete").select("media_sha256", F.array(F.struct("digest", "data")).alias("parts"), "digests", "lengths")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor()
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                b, out = batch.slice(k, 64), []
                for sha, parts, digests, lengths in zip(*(b.column(c).to_pylist() for c in ("media_sha256", "parts", "digests", "lengths"))):
                    found = {p["digest"]: open_.decompress(p["data"]) for p in parts}
                    out.append(features(sha, joined(sha, found.pop(None), found, digests, lengths), len(digests)))
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), _schema)], schema=_schema)

    return whole.mapInArrow(run, FEATURES).unionByName(mixed.mapInArrow(run, FEATURES)).dropDuplicates(["media_sha256"])


def joined(sha: str, own: bytes, found: dict[bytes, bytes], digests: list[bytes], lengths: list[int]) -> bytes:
    """The media from its own bytes and the shared chunks, each chunk and the whole verified by digest."""
    at, parts = 0, []
    for d, n in zip(digests, lengths):
        if d not in found:
            found[d] = own[at : at + n]
            at += n
        if digest(found[d]) != d:
            raise ValueError(f"media {sha}: a chunk is damaged")
        parts.append(found[d])
    media = b"".join(parts)
    if hashlib.sha256(media).hexdigest() != sha:
        raise ValueError(f"media {sha}: it doesn't match its digest")
    return media


def features(sha: str, media: bytes, n_chunks: int) -> tuple:
    """Sizes and digests of a media, and of its samples: sum, sum of squares, crossings of the middle."""
    payload = payload_of(media)
    samples = np.frombuffer(payload, np.uint8)
    times = np.bincount(samples, minlength=256)
    value = np.arange(256)
    crossings = int(np.count_nonzero((samples[1:] >= 128) != (samples[:-1] >= 128)))
    return sha, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-PAD:]), len(media), f"chunks={n_chunks};sum={int(times @ value)};squares={int(times @ (value * value))};crossings={crossings}"


def media_column(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature for each row of docs
    (doc_id, text; other columns are ignored), read back from the chunk store that is written first.

    A null text is empty (64 zero bytes), null and repeated ids keep their rows, an empty table gives none. Equal texts are
    one media: they are stored and rebuilt once."""
    with shuffles_dropped(docs.sparkSession):  # each step's result is a written table
        listed = written(manifests(docs), "manifests")
        store = store_media(docs, listed)
        got = written(rebuilt(store), "rebuilt")
        discarded(store)
    return listed.select("doc_id", "n_bytes", "media_sha256").join(got, "media_sha256").select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def op7_chunked_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_column(documents(spark, sf_dir))
