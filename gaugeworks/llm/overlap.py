"""Same or near-same records across splits (problem 3)."""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import plain, save, ship

# Image extensions that do not distinguish files.
IMAGE_EXTENSIONS = ["jpg", "jpeg", "png", "webp", "bmp"]
#: A perceptual hash of 32 hexadecimal digits is cut into six segments, so of at most ten differing bits one segment has
#: at most one; each segment has two halves (start, digits), and one of the halves is the same in both hashes.
SEGMENTS = [((0, 2), (2, 3)), ((5, 2), (7, 3)), ((10, 2), (12, 3)), ((15, 2), (17, 3)), ((20, 3), (23, 3)), ((26, 3), (29, 3))]
MAX_BITS = 10
#: Hashes of one side of a bucket of equal halves beyond which the bucket is cut into tiles.
HOT_BUCKET = 200_000
#: Pairs compared at once, and pairs of one equal segment beyond which further digits must be near before they are compared.
PAIRS, HOT_PAIRS = 2_000_000, 4_000_000
#: Bytes of evaluation text in one full-text index, and training keys that are streamed through one copy of it.
SHARD_BYTES, STREAM_ROWS = 8_000_000, 200_000


def file_key(path: Column | str) -> Column:
    """What file a path names: every layer of percent encoding undone, lower case, forward slashes, `.`, `..` and empty
    steps resolved as of a relative path, image extension removed. `#n` after a Parquet shard is part of the name."""
    p = F.trim(F.col(path) if isinstance(path, str) else path)
    escaped = "%[0-9A-Fa-f]{2}"

    def decoded(c):
        ready = F.regexp_replace(F.regexp_replace(c, "%(?![0-9A-Fa-f]{2})", "%25"), r"\+", "%2B")
        return F.when(c.rlike(escaped), F.coalesce(F.try_url_decode(ready), c)).otherwise(c)

    # Each layer is at least two characters shorter once undone, so there are at most half as many layers as characters.
    layers = F.sequence(F.lit(1), F.greatest(F.lit(1), (F.length(p) / 2).cast("int")))
    p = F.when(p.rlike(escaped), F.aggregate(layers, p, lambda acc, _: decoded(acc))).otherwise(p)
    p = F.lower(F.translate(p, "\\", "/"))
    steps = F.filter(F.split(p, "/"), lambda s: ~s.isin("", "."))
    walked = F.aggregate(steps, F.array().cast("array<string>"), lambda acc, s: F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(s))))
    joined = F.array_join(F.when(F.array_contains(steps, ".."), walked).otherwise(steps), "/")
    return F.regexp_replace(joined, r"\.(" + "|".join(IMAGE_EXTENSIONS) + r")$", "")


def _grouped(own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of a sorted array: where the group of equal values of each element starts, and whether it has others."""
    fresh = np.ones(len(own), dtype=bool)
    np.not_equal(own[1:], own[:-1], out=fresh[1:])
    start = np.arange(len(own), dtype=np.int32)
    start[~fresh] = 0
    np.maximum.accumulate(start, out=start)
    alone = fresh.copy()
    alone[:-1] &= fresh[1:]
    return start, ~alone


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Start positions of the sorted suffixes of a text (under 2 GB): by their first eight bytes, then prefix doubling of what
    is still equal. Takes about 30 bytes of memory for each of the text."""
    n = len(text)
    key = np.zeros(n, dtype=np.uint64)
    for j in range(8):
        key <<= np.uint64(8)
        key[: max(0, n - j)] |= text[j:]
    order = np.argsort(key)
    key = key[order]
    order = order.astype(np.int32)
    start, tied = _grouped(key)
    del key
    rank = np.full(n + 1, -1, dtype=np.int32)
    rank[order] = start
    at, h = np.flatnonzero(tied), 8
    del start, tied
    while len(at):
        pos = order[at]
        both = rank[pos].astype(np.int64) * (n + 1) + rank[np.minimum(pos.astype(np.int64) + h, n)] + 1
        o = np.argsort(both)
        order[at] = pos = pos[o]
        start, tied = _grouped(both[o])
        rank[pos] = at[start]
        at, h = at[tied], 2 * h
    return order


class TextIndex:
    """A compressed full-text index of distinct keys, for backward search.

    The text is the sorted keys, a separator before and after each. Its Burrows-Wheeler transform is a wavelet matrix over
    the bytes that occur: as many bits for each byte of text as their number needs, and a sampled rank for every 256 bits,
    so that it is smaller than the text. Neither the text nor its suffix array is kept.
    """

    def __init__(self, keys: list[bytes]):
        text = np.frombuffer(b"\x01" + b"\x01".join(sorted(keys)) + b"\x01\x00", dtype=np.uint8)
        counts = np.bincount(text, minlength=256)
        self.bytes_ = np.flatnonzero(counts).astype(np.uint8)
        code = np.zeros(256, dtype=np.uint8)
        code[self.bytes_] = np.arange(len(self.bytes_))
        code = code[text[suffix_order(text) - 1]]
        self.n = len(text)
        self.levels = max(1, int(len(self.bytes_) - 1).bit_length())
        words = -(-self.n // 256) * 4 + 4
        self.bits, self.zeros = np.zeros((self.levels, words), dtype=np.uint64), np.zeros(self.levels, dtype=np.int64)
        for level in range(self.levels):
            bit = (code >> (self.levels - 1 - level)) & 1
            packed = np.packbits(bit, bitorder="little")
            self.bits[level].view(np.uint8)[: len(packed)] = packed
            self.zeros[level] = self.n - int(bit.sum())
            code = np.concatenate([code[bit == 0], code[bit == 1]])
        counts = counts[self.bytes_]
        self._finish(np.cumsum(counts) - counts)

    def _finish(self, first: np.ndarray) -> None:
        ones = np.bitwise_count(self.bits).astype(np.uint32).reshape(self.levels, -1, 4).sum(2, dtype=np.uint32)
        self.ranks = (np.cumsum(ones, axis=1, dtype=np.uint32) - ones).astype(np.uint32)
        self.first = first
        self.code_of = np.full(256, -1, dtype=np.int64)
        self.code_of[self.bytes_] = np.arange(len(self.bytes_))
        every = np.arange(len(self.bytes_))
        self.shift = first - self._descend(every, np.zeros(len(every), dtype=np.int64))

    @property
    def size(self) -> int:
        return self.bits.nbytes + self.ranks.nbytes

    def to_bytes(self) -> bytes:
        head = np.array([self.n, self.levels, len(self.bytes_), self.bits.shape[1]], dtype=np.int64)
        return b"".join(x.tobytes() for x in (head, self.zeros, self.first.astype(np.int64), self.bits, self.bytes_))

    @classmethod
    def from_bytes(cls, blob: bytes) -> TextIndex:
        self = cls.__new__(cls)
        n, levels, kinds, words = np.frombuffer(blob, np.int64, 4).tolist()
        self.n, self.levels, at = n, levels, 32
        self.zeros = np.frombuffer(blob, np.int64, levels, at)
        first = np.frombuffer(blob, np.int64, kinds, at := at + 8 * levels)
        self.bits = np.frombuffer(blob, np.uint64, levels * words, at := at + 8 * kinds).reshape(levels, words)
        self.bytes_ = np.frombuffer(blob, np.uint8, kinds, at + 8 * levels * words)
        self._finish(first)
        return self

    def _rank(self, level: int, at: np.ndarray) -> np.ndarray:
        """Ones of a level before each position: a sampled rank and the bits since."""
        row, word = self.bits[level], at >> 6
        out = self.ranks[level][at >> 8].astype(np.int64)
        for k in range(3):
            more = np.flatnonzero((word & 3) > k)
            out[more] += np.bitwise_count(row[(word[more] & ~3) + k])
        low = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return out + np.bitwise_count(row[word] & low)

    def _descend(self, code: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level in range(self.levels):
            ones = self._rank(level, at)
            at = np.where((code >> (self.levels - 1 - level)) & 1 == 1, self.zeros[level] + ones, at - ones)
        return at

    def search(self, flat: np.ndarray, end: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of all patterns at once (bytes flat, each ending before `end`): the length of the maximal match
        that ends with the pattern, and how often that match occurs in the text."""
        lo, hi = np.zeros(len(length), dtype=np.int64), np.full(len(length), self.n, dtype=np.int64)
        matched = np.zeros(len(length), dtype=np.int64)
        live, step = np.flatnonzero(length > 0), 0
        while len(live):
            code = self.code_of[flat[end[live] - 1 - step]]
            live, code = live[code >= 0], code[code >= 0]
            both = self._descend(np.r_[code, code], np.r_[lo[live], hi[live]]) + np.r_[self.shift[code], self.shift[code]]
            a, b = both[: len(live)], both[len(live) :]
            found = b > a
            live = live[found]
            lo[live], hi[live] = a[found], b[found]
            step += 1
            matched[live] = step
            live = live[length[live] > step]
        return matched, np.where(matched > 0, hi - lo, 0)


def _escaped(k: bytes) -> bytes:
    """The separators' bytes never stand inside a key."""
    return k.replace(b"\x02", b"\x02\x05").replace(b"\x01", b"\x02\x04").replace(b"\x00", b"\x02\x03")


def _build(table: pa.Table) -> pa.Table:
    keys = [_escaped(k) for k in table.column("key").to_pylist()]
    return pa.table({"shard": table.column("shard").slice(0, 1), "index": pa.array([TextIndex(keys).to_bytes()], pa.binary())})


def _patterns(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The keys with a separator before and after each, as search() takes them."""
    keys = [b"\x01" + _escaped(k) + b"\x01" for k in keys]
    length = np.fromiter(map(len, keys), dtype=np.int64, count=len(keys))
    return np.frombuffer(b"".join(keys), dtype=np.uint8), np.cumsum(length), length


def _stream(batches):
    """Rows sorted by shard and turn: an index (turn 0), then the training keys that are streamed through it. A key is kept
    if its maximal match spans all of it, with both separators."""
    index = None
    for b in batches:
        turn = b.column("turn").to_numpy(zero_copy_only=False)
        cuts = [*np.flatnonzero(turn == 0).tolist(), len(turn)]
        at = 0
        for cut in cuts:
            if cut > at and index is not None:
                part = b.slice(at, cut - at)
                keys = part.column("data")
                flat, end, length = _patterns(keys.to_pylist())
                matched, times = index.search(flat, end, length)
                own = pa.array(np.flatnonzero((matched == length) & (times > 0)))
                if len(own):
                    yield pa.RecordBatch.from_arrays([part.column("item").take(own), keys.take(own).cast(pa.string())], names=["item", "key"])
            if cut < len(turn):
                blob = b.column("data")[cut].as_py()
                index = TextIndex.from_bytes(blob) if blob else None
            at = cut + 1


def stream_through_index(keys: DataFrame, shard_bytes: int = SHARD_BYTES, rows_each: int = STREAM_ROWS) -> DataFrame:
    """(item, key): training rows of (item, key, train boolean) whose key is a whole key of the evaluation side.

    The distinct evaluation keys become compressed full-text indexes of about shard_bytes of text each; one holds them all
    unless they are more. The training keys are streamed past an index by backward search, about rows_each for each copy
    of it; their maximal matches are kept where they span a whole key. Neither distinct training keys nor groups of
    equal ones are ever gathered. Of several indexes a key meets the one that its hash names.
    """
    held = save(keys.filter("not train").groupBy("key").agg(F.count(F.lit(1)).alias("records")), "held-keys")
    size, n = held.agg(F.sum(F.octet_length("key") + 1)).first()[0] or 0, keys.filter("train").count()
    shards = max(1, -(-size // shard_bytes))
    copies = max(1, -(-n // (shards * rows_each)))
    shard = lambda: F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int").alias("shard")
    index = held.select(shard(), F.col("key").cast("binary").alias("key")).groupBy("shard").applyInArrow(_build, "shard int, index binary")
    index = save(index, "index")
    turns = F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy")
    rows = index.select("shard", turns, F.lit(0).alias("turn"), F.lit(None).cast("long").alias("item"), F.col("index").alias("data"))
    asked = keys.filter("train").select(shard(), F.pmod(F.xxhash64("item"), F.lit(copies)).cast("int").alias("copy"), F.lit(1).alias("turn"), "item", F.col("key").cast("binary").alias("data"))
    ordered = rows.unionByName(asked).repartition(shards * copies, "shard", "copy").sortWithinPartitions("shard", "copy", "turn")
    return ordered.select("turn", "item", "data").mapInArrow(_stream, "item bigint, key string")


def _own(df: DataFrame, train: bool) -> DataFrame:
    """Columns of new identity: the two sides of a cogroup come from one table."""
    for c in df.columns:
        df = df.withColumnRenamed(c, f"{c}_{train}").withColumn(c, F.col(f"{c}_{train}")).drop(f"{c}_{train}")
    return df


def _words(hashes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(hashes), dtype=">u8").astype(np.uint64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def _digits(hi: np.ndarray, lo: np.ndarray, digits) -> np.ndarray:
    """The given hexadecimal digits of 128-bit numbers, as one number."""
    out = np.zeros(len(hi), dtype=np.int64)
    for d in digits:
        word, at = (hi, d) if d < 16 else (lo, d - 16)
        out = (out << 4) | ((word >> np.uint64(60 - 4 * at)) & np.uint64(15)).astype(np.int64)
    return out


class _Pairs:
    """Pairs of 128-bit numbers within `most` (at most 11) bits."""

    def __init__(self, a: list[bytes], b: list[bytes], most: int):
        (self.ah, self.al), (self.bh, self.bl), self.most = _words(a), _words(b), most

    def lookup(self, ia: np.ndarray, ib: np.ndarray, digits, flips: list[int], depth: int = 3) -> list[tuple]:
        """Near pairs of rows ia and ib whose digits are equal after one of the flips."""
        va, vb = _digits(self.ah[ia], self.al[ia], digits), _digits(self.bh[ib], self.bl[ib], digits)
        order = np.argsort(va, kind="stable")
        va, ia = va[order], ia[order]
        found = []
        for flip in flips:
            want = vb ^ flip
            x, y = np.searchsorted(va, want, "left"), np.searchsorted(va, want, "right")
            hit = np.flatnonzero(y > x)
            if depth and (y - x).sum() > HOT_PAIRS:
                runs, run, each = np.unique(x[hit], return_inverse=True, return_counts=True)
                hot = each * (np.searchsorted(va, va[runs], "right") - runs) > HOT_PAIRS
                for k in np.flatnonzero(hot):
                    own = hit[run == k]
                    found += self.split(ia[x[own[0]] : y[own[0]]], ib[own], depth)
                hit = hit[~hot[run]]
            found += self.compare(ia, ib[hit], x[hit], y[hit])
        return found

    def split(self, ia: np.ndarray, ib: np.ndarray, depth: int) -> list[tuple]:
        """Near pairs of all rows ia and ib. The digits that vary are dealt into six blocks, of which one has at most one
        differing bit, as of the six segments; where too few vary, all pairs are compared."""
        every = [self.ah[ia], self.bh[ib]], [self.al[ia], self.bl[ib]]
        vary = [np.bitwise_or.reduce([np.bitwise_or.reduce(w) for w in side]) ^ np.bitwise_and.reduce([np.bitwise_and.reduce(w) for w in side]) for side in every]
        digits = [d for d in range(32) if int(vary[d // 16]) >> (60 - 4 * (d % 16)) & 15]
        if len(digits) < 12:
            return self.compare(ia, ib, np.zeros(len(ib), np.int64), np.full(len(ib), len(ia)))
        found = []
        for k in range(6):
            block = digits[k::6]
            found += self.lookup(ia, ib, block, [0, *(1 << t for t in range(4 * len(block)))], depth - 1)
        i, j, bits = _joined(found)
        _, once = np.unique(i * len(self.bh) + j, return_index=True)
        return [(i[once], j[once], bits[once])]

    def compare(self, ia: np.ndarray, ib: np.ndarray, x: np.ndarray, y: np.ndarray) -> list[tuple]:
        """Near pairs of each row of ib with rows x to y of ia, about PAIRS at once."""
        n = y - x
        upto = np.cumsum(n)
        found, at = [], 0
        while at < len(n):
            to = max(at + 1, int(np.searchsorted(upto, upto[at] - n[at] + PAIRS, "right")))
            m = n[at:to]
            i, j = ia[np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + np.repeat(x[at:to], m)], np.repeat(ib[at:to], m)
            bits = np.bitwise_count(self.ah[i] ^ self.bh[j]).astype(np.int64) + np.bitwise_count(self.al[i] ^ self.bl[j])
            near = bits <= self.most
            if near.any():
                found.append((i[near], j[near], bits[near]))
            at = to
        return found


def _joined(found: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found))


def near_hashes(a: list[bytes], b: list[bytes], route_a: np.ndarray, route_b: np.ndarray, most: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions in a and b, and differing bits, of hashes (16 bytes each) within `most` bits that meet on a route.

    Route 2 s + h: half h of segment s is equal. The segment of b is looked up among the sorted segments of a as it is
    and with each bit of the other half turned; what is found is compared in full, about PAIRS pairs at once. A segment
    that many hashes of both sides share (more than HOT_PAIRS pairs) is first cut by its other digits (_Pairs.split).
    """
    pairs = _Pairs(a, b, most)
    found = []
    for s, (first, second) in enumerate(SEGMENTS):
        low = 4 * second[1]
        for h in (0, 1):
            ia, ib = np.flatnonzero(route_a == 2 * s + h), np.flatnonzero(route_b == 2 * s + h)
            if not len(ia) or not len(ib):
                continue
            turns = range(low) if h == 0 else range(low, low + 4 * first[1])  # the half that may differ
            flips = [*([0] if h == 0 else []), *(1 << t for t in turns)]  # equal segments meet on route h = 0
            found += pairs.lookup(ia, ib, range(first[0], first[0] + first[1] + second[1]), flips)
    return _joined(found)


def _near(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    if not len(left) or not len(right):
        return pd.DataFrame({"eval_hash": pd.Series([], dtype=object), "train_hash": pd.Series([], dtype=object), "bits": pd.Series([], dtype="int32")})
    a, b = left["phash"].tolist(), right["phash"].tolist()
    i, j, bits = near_hashes(a, b, left["route"].to_numpy(), right["route"].to_numpy())
    _, once = np.unique(i * len(b) + j, return_index=True)
    return pd.DataFrame({"eval_hash": pd.Series([a[x] for x in i[once]], dtype=object), "train_hash": pd.Series([b[x] for x in j[once]], dtype=object), "bits": bits[once].astype(np.int32)})


def near_phashes(hashes: DataFrame, rows_each: int = 150_000) -> DataFrame:
    """(eval_hash, train_hash, bits): hashes of the two sides of (phash, train boolean) that differ in at most 10 of 128 bits.

    Each distinct hash goes to twelve routes (segment, equal half), each a hash of the half's digits. Routes are the groups
    of one shuffle; in each, evaluation segments are sorted and training segments looked up (near_hashes). A route's
    bucket with more than HOT_BUCKET hashes of either side is cut into tiles: each side is dealt into parts of that size, and
    every part of one meets every part of the other once. Cost grows with the number of distinct hashes, save for what chance brings together.
    """
    hashes = save(hashes.filter("phash is not null").distinct(), "phashes")
    n = hashes.count()
    halves = [h for s in SEGMENTS for h in s]
    routes = F.posexplode(F.array(*[F.substring("phash", start + 1, count) for start, count in halves])).alias("route", "digits")
    routed = hashes.select(F.unhex("phash").alias("phash"), "train", routes)  # 16 bytes travel, not 32 digits
    shards = max(1, -(-12 * n // rows_each))
    routed = routed.withColumn("tile", F.lit(0))
    if n > HOT_BUCKET:
        number = lambda t: F.sum(F.when(F.col("train") == t, 1).otherwise(0))
        per = routed.groupBy("route", "digits").agg(number(True).alias("t"), number(False).alias("e"))
        hot = save(per.filter(F.greatest("t", "e") > HOT_BUCKET).select("route", "digits", F.ceil(F.col("t") / HOT_BUCKET).cast("int").alias("t"), F.ceil(F.col("e") / HOT_BUCKET).cast("int").alias("e")), "hot")
        if not hot.isEmpty():
            d = routed.join(F.broadcast(hot), ["route", "digits"], "left")  # at most 16 ** 2 x 4 + 16 ** 3 x 8 rows
            t, e = F.greatest(F.coalesce("t", F.lit(1)), F.lit(1)), F.greatest(F.coalesce("e", F.lit(1)), F.lit(1))
            deal = lambda k: F.pmod(F.xxhash64("phash"), k).cast("int")
            tiles = F.when(F.col("train"), F.transform(F.sequence(F.lit(0), e - 1), lambda x: x * t + deal(t))).otherwise(F.transform(F.sequence(F.lit(0), t - 1), lambda x: deal(e) * t + x))
            routed = d.select("phash", "train", "route", "digits", F.explode(tiles).alias("tile"))
    routed = routed.select("phash", "train", F.col("route").cast("int").alias("route"), F.pmod(F.xxhash64("route", "digits", "tile"), F.lit(shards)).alias("shard"))
    side = lambda t: _own(routed.filter(F.col("train") == t).select("shard", "route", "phash"), t).groupBy("shard")
    near = side(False).cogroup(side(True)).applyInPandas(_near, "eval_hash binary, train_hash binary, bits int").distinct()
    return near.select(F.lower(F.hex("eval_hash")).alias("eval_hash"), F.lower(F.hex("train_hash")).alias("train_hash"), "bits")


def _matches(samples: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(rows, keyed, exact, near): records with their keys and hashes, (item, train, key), the training rows of keyed that
    match, and near pairs of hashes."""
    phash = F.lower(F.trim("phash"))
    rows = samples.filter("sample_id is not null and split is not null").select(
        F.col("sample_id").cast("long").alias("item"), (plain("split") == "train").alias("train"), F.concat(F.lit("p:"), file_key("path")).alias("file"), F.concat(F.lit("h:"), F.lower(F.trim("content_hash"))).alias("pixels"),
        F.when(phash.rlike("^[0-9a-f]{32}$") & ~phash.rlike("^0+$"), phash).alias("phash"))
    rows = save(rows.distinct(), "records")
    keyed = rows.select("item", "train", F.explode(F.array("file", "pixels")).alias("key")).filter("key is not null")
    exact = save(stream_through_index(keyed), "matches")
    return rows, keyed, exact, near_phashes(rows.select("phash", "train"))


_KINDS = ("same_file", "same_pixels", "near_picture")


def cross_split_pairs(samples: DataFrame) -> DataFrame:
    """(train_id, other_id, same_file, same_pixels, near_picture): records of the training split and of another split that
    show the same picture, by path, content hash or perceptual hash (at most 10 of 128 bits apart).

    samples: (sample_id, path, split, content_hash, phash). Records with a null split or sample_id take no part. A null
    path, content hash or perceptual hash, a perceptual hash of zeros only or of another form than 32 hexadecimal digits
    gives no evidence. Letter case and white space of split, and letter case of both hashes, never matter. Repeated rows
    count once. Keys and hashes are made distinct before they are compared, so a group of copies is compared once; its
    pairs are written out only where both sides have it.
    """
    rows, keyed, exact, near = _matches(samples)
    t = exact.select("key", F.col("item").alias("train_id"))
    o = keyed.filter("not train").select("key", F.col("item").alias("other_id"))
    exact = t.join(o, "key").select("train_id", "other_id", F.col("key").startswith("p:").alias("same_file"), F.col("key").startswith("h:").alias("same_pixels"), F.lit(False).alias("near_picture"))
    pictured = rows.filter("phash is not null")
    near = near.join(pictured.filter("train").select(F.col("phash").alias("train_hash"), F.col("item").alias("train_id")), "train_hash").join(pictured.filter("not train").select(F.col("phash").alias("eval_hash"), F.col("item").alias("other_id")), "eval_hash")
    pairs = exact.unionByName(near.select("train_id", "other_id", F.lit(False).alias("same_file"), F.lit(False).alias("same_pixels"), F.lit(True).alias("near_picture")))
    return pairs.groupBy("train_id", "other_id").agg(*[F.max(c).alias(c) for c in _KINDS])


def overlap_report(samples: DataFrame) -> DataFrame:
    """Per split other than train and per source: records, and those whose picture stands in the training split, by kind.

    Evaluation records are marked by the keys and hashes that matched; their pairs are never written out.
    """
    rows, keyed, exact, near = _matches(samples)
    held = keyed.filter("not train").select("item", "key").join(exact.select("key").distinct(), "key")
    marked = held.select(F.col("item").alias("other_id"), F.col("key").startswith("p:").alias("same_file"), F.col("key").startswith("h:").alias("same_pixels"), F.lit(False).alias("near_picture"))
    alike = rows.filter("not train").select("item", F.col("phash").alias("eval_hash")).join(near.select("eval_hash").distinct(), "eval_hash")
    marked = marked.unionByName(alike.select(F.col("item").alias("other_id"), F.lit(False).alias("same_file"), F.lit(False).alias("same_pixels"), F.lit(True).alias("near_picture")))
    per = marked.groupBy("other_id").agg(*[F.max(c).alias(c) for c in _KINDS])
    all_rows = samples.filter("sample_id is not null and split is not null").select(F.col("sample_id").cast("long").alias("other_id"), plain("split").alias("split"), plain("source").alias("source")).filter("split <> 'train'").distinct()
    number = lambda c: F.sum(F.coalesce(F.col(c).cast("int"), F.lit(0))).alias(c)
    joined = all_rows.join(per, "other_id", "left").withColumn("overlapping", F.col("near_picture").isNotNull())
    return joined.groupBy("split", "source").agg(F.count(F.lit(1)).alias("records"), number("overlapping"), *[number(c) for c in _KINDS])


ship(sys.modules[__name__])
