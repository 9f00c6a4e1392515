"""Chroma fingerprints of audio columns, and alignment of recordings that share passages.

A recording is a WAV file in a binary column (PCM, 8 or 16 bits, any rate and channels). Short-time spectra are folded into
twelve pitch classes a frame, each frame scaled to length one. Rectangle filters, computed from an integral image over
(frame, pitch class), compare neighbouring regions; each filter's value falls into one of four ranges, coded in two bits
such that neighbouring ranges differ in one bit. Sixteen filters give a 32-bit integer per frame position.

Alignment: recordings with the same integers are one class. Two classes that share an integer vote for the offset
between its positions; a run of one constant integer, as in silence, has one vote for each offset at which its beginnings or
its ends meet. Every offset with enough votes (or with those of all runs, where a recording has fewer) is examined: it aligns
the classes if stretches of a least length have a share of differing bits within the bound, whatever lies around them. A pair
has one row for each such offset, so passages at several offsets are all found. Queries are a stated set of recordings,
compared with all others.

Defined cases: a null or empty recording, one that is no WAV file or is shorter than a filter has an empty fingerprint and
aligns with nothing; silence has frames of zeros and a fingerprint of its own kind; repeated rows share a class, and rows
with the query's id are not among its matches; null ids take no part in alignment; an empty table gives an empty result.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkweave.session import staged

FRAME_SECONDS, HOP_SECONDS = 0.25, 0.125
LOWEST, HIGHEST = 65.0, 2100.0  # Hz: what counts for pitch classes
# Filters by a rule: for each width in frames, one over each third of the pitch classes, of the kind given by their number.
WIDTHS = (2, 4, 8, 12, 16)
FILTERS = [(i % 4, WIDTHS[i % 5], 3 * (i % 4), 3 if i % 2 else 6) for i in range(16)]  # kind, frames, first class, classes
SPAN = max(WIDTHS)
# Ranges of a filter's value, which lies between -1 and 1 for unit frames.
EDGES = np.array([-0.05, 0.0, 0.05])
GRAY = np.array([0, 1, 3, 2], np.uint32)


def wav(samples: np.ndarray, rate: int) -> bytes:
    """A 16-bit mono WAV file of samples between -1 and 1."""
    data = (np.clip(samples, -1, 1) * 32767).astype("<i2").tobytes()
    return b"RIFF" + struct.pack("<I", 36 + len(data)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, 2 * rate, 2, 16) + b"data" + struct.pack("<I", len(data)) + data


def samples_of(data: bytes | None) -> tuple[np.ndarray, int]:
    """Mono samples and rate of a WAV file; none for anything else."""
    none = np.empty(0), 1
    if not data or data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        return none
    at, form = 12, None
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if name == b"fmt " and size >= 16 and at + 24 <= len(data):
            form = struct.unpack_from("<HHIIHH", data, at + 8)
        elif name == b"data" and form:
            kind, channels, rate, _, _, bits = form
            if kind != 1 or not channels or not rate or bits not in (8, 16):
                return none
            width = channels * bits // 8
            raw = data[at + 8 : at + 8 + size]
            raw = raw[: len(raw) // width * width]
            x = np.frombuffer(raw, "<i2").astype(float) / 32768 if bits == 16 else (np.frombuffer(raw, np.uint8).astype(float) - 128) / 128
            return x.reshape(-1, channels).mean(axis=1), rate
        at += 8 + size + (size & 1)
    return none


def chroma(samples: np.ndarray, rate: int) -> np.ndarray:
    """Frames of twelve pitch classes, each of length one or zero."""
    size, hop = int(rate * FRAME_SECONDS), max(1, int(rate * HOP_SECONDS))
    if size < 2 or len(samples) < size:
        return np.empty((0, 12))
    frequency = np.fft.rfftfreq(size, 1 / rate)
    use = np.flatnonzero((frequency >= LOWEST) & (frequency <= HIGHEST))
    fold = np.zeros((len(use), 12))
    fold[np.arange(len(use)), np.round(12 * np.log2(frequency[use] / 440.0)).astype(int) % 12] = 1
    frames = np.lib.stride_tricks.sliding_window_view(samples, size)[::hop]
    out = np.empty((len(frames), 12))
    window = np.hanning(size)
    for i in range(0, len(frames), 256):  # long recordings in parts
        out[i : i + 256] = np.square(np.abs(np.fft.rfft(frames[i : i + 256] * window, axis=1)[:, use])) @ fold
    norm = np.sqrt(np.square(out).sum(axis=1, keepdims=True))
    return np.divide(out, norm, out=np.zeros_like(out), where=norm > 1e-9)


def fingerprint(frames: np.ndarray) -> np.ndarray:
    """The packed integers of chroma frames, one for each position where the widest filter fits."""
    n = len(frames) - SPAN + 1
    if n <= 0:
        return np.empty(0, np.uint32)
    image = np.zeros((len(frames) + 1, 13))
    image[1:, 1:] = frames.cumsum(axis=0).cumsum(axis=1)

    def box(start: int, width: int, low: int, high: int) -> np.ndarray:
        a, b = image[start : start + n], image[start + width : start + width + n]
        return b[:, high] - b[:, low] - a[:, high] + a[:, low]

    out = np.zeros(n, np.uint32)
    for kind, width, low, classes in FILTERS:
        high = min(12, low + classes)
        middle, half = (low + high) // 2, width // 2
        if kind == 0:  # upper against lower classes
            value = box(0, width, low, middle) - box(0, width, middle, high)
        elif kind == 1:  # earlier against later frames
            value = box(0, half, low, high) - box(half, width - half, low, high)
        elif kind == 2:  # crosswise
            value = box(0, half, low, middle) + box(half, width - half, middle, high) - box(0, half, middle, high) - box(half, width - half, low, middle)
        else:  # against the whole frame
            value = box(0, width, low, high) - box(0, width, 0, 12) * (high - low) / 12
        out = out << np.uint32(2) | GRAY[np.searchsorted(EDGES, value / (width * max(1, high - low)))]
    return out


def fingerprints(recordings: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """(id, codes): the fingerprint of each recording as an array of longs from 0 to 2^32 - 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                codes = [fingerprint(chroma(*samples_of(m.as_py()))).astype(np.int64) for m in part.column("media")]
                yield pa.record_batch([part.column("id"), pa.array(codes, pa.list_(pa.int64()))], names=["id", "codes"])

    narrow = recordings.select(F.col(id_col).cast("long").alias("id"), F.col(media_col).cast("binary").alias("media"))
    return narrow.mapInArrow(run, "id long, codes array<long>")


def stretches(differing: np.ndarray, least: int, most_errors: float) -> list[tuple[int, int]]:
    """Disjoint stretches [begin, end) of at least `least` positions whose share of differing bits is at most `most_errors`:
    the one that stays furthest below the bound in sum, then those before and behind it."""
    found, open_ = [], [(0, len(differing))]
    while open_:
        low, high = open_.pop()
        if high - low < least:
            continue
        sums = np.concatenate([[0.0], np.cumsum(32 * most_errors - differing[low:high])])
        lowest = np.minimum.accumulate(sums[: len(sums) - least])
        gain = sums[least:] - lowest
        end = int(gain.argmax())
        if gain[end] < -1e-6:
            continue
        begin = int(sums[: end + 1].argmin())
        found.append((low + begin, low + end + least))
        open_ += [(low, low + begin), (low + end + least, high)]
    return sorted(found)


def align(prints: DataFrame, is_query: Column, least_votes: int = 2, least_overlap: int = 16, most_errors: float = 0.25) -> tuple[DataFrame, DataFrame]:
    """Alignments between classes of recordings, and the members of the classes.

    (query_class, class, offset, votes, overlap, bit_error): position p of the query lies at p + offset of the other; `overlap`
    counts the positions of the matching stretches, each of at least `least_overlap`, and `bit_error` is the share over them.
    (id, class, is_query): a class is named after its smallest id. A class is aligned with itself if it has other members."""
    known = staged(prints.filter(F.col("id").isNotNull() & (F.size("codes") > 0)).withColumn("key", F.xxhash64("codes")))
    classes = known.groupBy("key", F.size("codes").alias("n")).agg(F.min("id").alias("class"), F.max(is_query.cast("int")).alias("asks"))
    members = staged(known.withColumn("n", F.size("codes")).join(classes.select("key", "n", "class", "asks"), ["key", "n"]).select("id", "class", "asks", is_query.alias("is_query"), "codes"))
    heads = staged(members.filter("id = class").dropDuplicates(["class"]).select("class", "asks", "codes"))
    # runs of one code: the k-th begins at begins[k] and ends before the next one
    places = F.sequence(F.lit(0), F.size("codes") - 1)
    begins = F.filter(places, lambda i: (i == 0) | (F.get("codes", i) != F.get("codes", i - 1)))
    runs = heads.withColumn("begins", begins).withColumn("runs", F.size("begins"))
    runs = runs.select("class", "asks", "codes", "runs", F.arrays_zip("begins", F.concat(F.slice("begins", F.lit(2), F.col("runs")), F.array(F.size("codes"))).alias("ends")).alias("r"))
    runs = runs.select("class", "asks", "runs", F.explode(F.transform("r", lambda r: F.struct(r["begins"].alias("begin"), r["ends"].alias("end"), F.get("codes", r["begins"]).alias("code")))).alias("r")).select("class", "asks", "runs", "r.*")
    ours = runs.filter("asks = 1").select(F.col("class").alias("query_class"), F.col("begin").alias("qbegin"), F.col("end").alias("qend"), F.col("runs").alias("qruns"), "code")
    votes = ours.join(runs.select("class", "begin", "end", "runs", "code"), "code").filter("query_class <> class")
    votes = votes.select("query_class", "class", F.least("runs", "qruns").alias("most"), F.explode(F.array_distinct(F.array(F.col("begin") - F.col("qbegin"), F.col("end") - F.col("qend")))).alias("offset"))
    votes = votes.groupBy("query_class", "class", "offset").agg(F.count("*").alias("votes"), F.max("most").alias("most")).filter(F.col("votes") >= F.least(F.lit(least_votes), F.col("most")))
    pairs = votes.groupBy("query_class", "class").agg(F.collect_list(F.struct("offset", "votes")).alias("offsets"))
    both = pairs.join(heads.select(F.col("class").alias("query_class"), F.col("codes").alias("_q")), "query_class").join(heads.select("class", F.col("codes").alias("_c")), "class")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["query_class", "class", "offset", "votes", "overlap", "bit_error"]
        for batch in batches:
            out = []
            for at in range(batch.num_rows):
                query_class, other, offsets = (batch.column(c)[at].as_py() for c in ("query_class", "class", "offsets"))
                q, c = (batch.column(n)[at].values.to_numpy(zero_copy_only=False) for n in ("_q", "_c"))
                for o in offsets:
                    start, offset = max(0, -o["offset"]), o["offset"]
                    size = min(len(q) - start, len(c) - start - offset)
                    differing = np.bitwise_count(q[start : start + size] ^ c[start + offset : start + offset + size]).astype(np.int64)
                    parts = stretches(differing, least_overlap, most_errors)
                    if parts:
                        overlap = sum(e - b for b, e in parts)
                        out.append((query_class, other, offset, o["votes"], overlap, float(sum(differing[b:e].sum() for b, e in parts)) / (32 * overlap)))
            columns = list(zip(*out)) if out else [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.float64()]
            yield pa.record_batch([pa.array(x, k) for x, k in zip(columns, kinds)], names=names)

    aligned = both.select("query_class", "class", "offsets", "_q", "_c").mapInArrow(verify, "query_class long, class long, offset int, votes long, overlap int, bit_error double")
    return aligned, members.select("id", "class", "is_query")


def tones(vectors: DataFrame, id_col: str, vec_col: str, rate: int = 4410, seconds: float = 0.125) -> DataFrame:
    """(id_col, media): a recording of each vector, a tone for each component, higher for a larger one. The given tables hold
    no audio; this makes a media column from them. A null vector has a null recording; missing components are silent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = np.arange(int(rate * seconds)) / rate
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part, out = batch.slice(at, 64), []
                for v in part.column(1).to_pylist():
                    if v is None:
                        out.append(None)
                        continue
                    x = np.array([np.nan if c is None else c for c in v], float)
                    pitch = 220.0 * 2 ** (np.round(np.clip(np.where(np.isfinite(x), x, 0), -1, 1) * 24) / 12)
                    out.append(wav((np.sin(2 * np.pi * pitch[:, None] * t) * 0.5 * np.isfinite(x)[:, None]).ravel(), rate))
                yield pa.record_batch([part.column(0), pa.array(out, pa.binary())], names=["id", "media"])

    return vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).mapInArrow(run, "id long, media binary")


def query(vectors: DataFrame, every: int = 50) -> DataFrame:
    """A row per recording: its fingerprint's length and digest, its class, and for the stated queries how many other
    classes they align with, the best of them with offset and bit error."""
    prints = staged(fingerprints(tones(vectors, "vec_id", "embedding"), "id", "media"))
    found, members = align(prints, F.col("id") % every == 0)
    of_pair = Window.partitionBy("query_class", "class").orderBy("bit_error", F.desc("overlap"), F.abs("offset"), "offset")
    found = found.withColumn("nth", F.row_number().over(of_pair)).filter("nth = 1").drop("nth")
    order = Window.partitionBy("query_class").orderBy("bit_error", F.desc("overlap"), "class")
    ranked = found.withColumn("rank", F.row_number().over(order)).withColumn("aligned", F.count("*").over(Window.partitionBy("query_class")))
    first = ranked.filter("rank = 1").select(F.col("query_class").alias("class"), "aligned", F.col("class").alias("best_class"), "offset", "votes", "overlap", "bit_error")
    rows = prints.select("id", F.size("codes").alias("n_codes"), F.sha2(F.concat_ws(",", "codes"), 256).alias("codes_sha256"))
    of = members.select("id", "class", "is_query").distinct()
    named = rows.join(of, "id", "left").join(first, "class", "left")
    mine = lambda c: F.when(F.col("is_query"), F.col(c)).alias(c)
    return named.select(
        F.col("id").alias("vec_id"), "n_codes", "codes_sha256", F.col("class").alias("class_id"), F.when(F.col("is_query"), F.coalesce("aligned", F.lit(0))).alias("aligned"),
        mine("best_class"), mine("offset"), mine("votes"), mine("overlap"), F.when(F.col("is_query"), F.round("bit_error", 6)).alias("bit_error"),
    )
