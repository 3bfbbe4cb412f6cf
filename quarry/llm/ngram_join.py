"""Near duplicates by an exact Jaccard join of word n-gram sets with token-combination prefixes.

A document's tokens are the hashes of its distinct 5-word shingles. Equal sets collapse to one class
first. Tokens have one global order: rare ones first, then frequent ones, each by hash. Sets that link
differ in few tokens, so a prefix that is long enough shares one with the other's. A rare token is
indexed by itself. Frequent tokens are dealt into many sub-classes, and only combinations of two of a
sub-class are indexed; a sub-class with c tokens of the prefix survives any c - 2 misses, and the prefix
is extended until all its sub-classes together survive every allowed number of misses. So no link is
lost, and common passages make few candidates.

Candidates of a signature aren't paired with each other at once. Each is paired with the signature's
hub, the set that shares the most signatures; what links is joined to components. Only where members
of a hub's group are still in different components are they paired with each other, in blocks. Bitmaps
that bound how far two sets differ drop most pairs that can't link; all others are verified on whole
sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from quarry.llm.common import WordIds, discard, if_small, map_arrow, plain_names, stored, table, text_or_empty

NGRAM = 5
#: Link if 100 * intersection >= PERCENT * union.
PERCENT = 80
#: A token in at least so many documents is frequent; the floor rises with the corpus, so that there are at most MAX_FREQUENT.
FREQUENT, MAX_FREQUENT = 64, 1_000_000
#: Tokens that a task counts at once: twice MAX_FREQUENT, so that a token at the floor is in a full buffer
#: twice on average and is counted there; those found once in a buffer aren't sent on.
COUNT_TOKENS = 2 * MAX_FREQUENT
#: A signature that so many texts of one in HOT_SHARE have is hot: its rows are dealt by set too. This decides where rows
#: lie, never what is found. At most MAX_HOT signatures are, those of the most texts.
HOT, HOT_SHARE, MAX_HOT = 64, 16, 200_000
#: Pairs of one hub that one task verifies; parts that joins deal a hub's group to; sets of a block of a hub's group.
HUB_PAIRS, SALTS, GROUP_BLOCK = 512, 32, 512
#: Steps of sizes that a large group is ordered by, to each doubling.
SIZE_STEPS = 16

_M = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _M[3]
    return x ^ (x >> np.uint64(29))


def shingle_set(text: str, words: WordIds, n: int = NGRAM) -> np.ndarray:
    """Sorted hashes of the distinct ``n``-word shingles; of the whole, if it has fewer words; A-Z count as a-z."""
    w = text.encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    h = words.of(w)
    if len(w) < n:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(w), seed=len(w))], np.uint64)
    s = h[: len(w) - n + 1] * _M[0]
    for k in range(1, n):
        s = s + h[k : len(w) - n + 1 + k] * _M[k % 5] * np.uint64(2 * (k // 5) + 1)
    return np.unique(_mixed(s))


def fingerprint(tokens: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(tokens.tobytes())


def spread(n: int) -> int:
    """Sub-classes of frequent tokens for sets of about ``n`` tokens: a power of two, an eighth of n at most."""
    return max(1, (1 << (n.bit_length() - 1)) // 8) if n else 1


def signatures(tokens: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """The signatures of a set; two sets that link share one. ``frequent``: sorted tokens."""
    n = len(tokens)
    misses = n * (100 - PERCENT) // 100  # at most so many tokens are not in a set it links with
    if len(frequent):
        place = np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)
        common = frequent[place] == tokens
        rare, often = tokens[~common], tokens[common]
    else:
        rare, often = tokens, tokens[:0]
    out = [rare[: misses + 1]]
    need = misses + 1 - len(rare)
    if need > 0:
        for g in sorted({spread(-(-n * PERCENT // 100)), spread(n), spread(n * 100 // PERCENT)}):
            g = np.uint64(g)
            sub = (_mixed(often) >> np.uint64(7)) % g
            _, first = np.unique(sub, return_index=True)
            new = np.zeros(len(often), np.int64)
            new[first] = 1
            survives = np.arange(1, len(often) + 1) - np.cumsum(new)
            m = int(np.searchsorted(survives, need)) + 1
            for c in range(1, m):  # tokens c apart within the prefix, in order of sub-class
                order = np.argsort(sub[:m], kind="stable")
                s, t = sub[:m][order], often[:m][order]
                same = np.flatnonzero(s[c:] == s[:-c])
                if not len(same):
                    break
                out.append(_mixed(t[same] * _M[0] + t[same + c] * _M[1] + g * _M[4:]))
    return np.unique(np.concatenate(out))


def parity(tokens: np.ndarray) -> bytes:
    """A bitmap of one to two bits a token; a bit tells if an odd number of tokens falls on it."""
    bits = max(64, 1 << (len(tokens) - 1).bit_length()) if len(tokens) else 64
    at, n = np.unique(_mixed(tokens ^ _M[2]) % np.uint64(bits), return_counts=True)
    odd = np.zeros(bits, np.uint8)
    odd[at[n % 2 == 1].astype(np.int64)] = 1
    return np.packbits(odd, bitorder="little").tobytes()


def may_link(a: int, bits_a: bytes, b: int, bits_b: bytes) -> bool:
    """False only if sets of ``a`` and ``b`` tokens can't link: bits that differ are tokens that only one of them has.

    Bitmaps of unlike lengths are compared after the longer is folded, half on half.
    """
    while len(bits_a) != len(bits_b):
        if len(bits_a) < len(bits_b):
            bits_a, bits_b = bits_b, bits_a
        half = len(bits_a) // 2
        bits_a = (int.from_bytes(bits_a[:half], "little") ^ int.from_bytes(bits_a[half:], "little")).to_bytes(half, "little")
    apart = (int.from_bytes(bits_a, "little") ^ int.from_bytes(bits_b, "little")).bit_count()
    # a + b = both + union and apart <= union - both, so both <= (a + b - apart) / 2.
    return 100 * (a + b - apart) >= PERCENT * (a + b + apart)


def _folded(bits: np.ndarray, words: int) -> np.ndarray:
    while bits.shape[1] > words:
        half = bits.shape[1] // 2
        bits = bits[:, :half] ^ bits[:, half:]
    return bits


def cell_pairs(rows: list[tuple]) -> list[tuple[bytes, bytes]]:
    """Pairs of a cell's rows (hub, x, y, own block, fp, label, n, bits) that may link and aren't joined, the smaller fp first."""
    _, x, y, *_ = rows[0]
    names: dict[bytes, int] = {}
    label = np.array([names.setdefault(r[5], len(names)) for r in rows])
    if len(names) < 2:
        return []
    own, n, length = (np.array(v) for v in zip(*((r[3], r[6], len(r[7]) // 8) for r in rows), strict=True))
    out = []
    for words in np.unique(length):
        small = np.flatnonzero(length == words)
        both = np.flatnonzero((length == words) | (length == 2 * words))
        bits = np.concatenate([_folded(np.frombuffer(b"".join(rows[k][7] for k in both if length[k] == w), np.uint64).reshape(-1, w), words) for w in (words, 2 * words) if (length[both] == w).any()])
        both = np.concatenate([both[length[both] == w] for w in (words, 2 * words)])
        place = {int(k): j for j, k in enumerate(both)}
        for i in small:
            ok = (label[both] != label[i]) & ((length[both] > words) | (both > i)) & ((own[both] != own[i]) | (x == y))
            ok &= np.minimum(n[both], n[i]) * 100 >= np.maximum(n[both], n[i]) * PERCENT
            at = np.flatnonzero(ok)
            if len(at):
                differ = np.bitwise_count(bits[at] ^ bits[place[int(i)]]).sum(1, dtype=np.int64)
                total = n[both[at]] + n[i]
                out += [tuple(sorted((rows[i][4], rows[k][4]))) for k in both[at[100 * (total - differ) >= PERCENT * (total + differ)]]]
    return out


def links(a: np.ndarray, b: np.ndarray) -> bool:
    if min(len(a), len(b)) * 100 < PERCENT * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, n, fp and bits of each row; and, in rows without fp, tokens that several sets of a task's part have."""
    words = WordIds()
    held: list[np.ndarray] = []
    seen: set[bytes] = set()

    def repeated() -> pa.RecordBatch:
        tokens, n = np.unique(np.concatenate(held) if held else np.zeros(0, np.uint64), return_counts=True)
        tokens, n = tokens[n > 1].view(np.int64), n[n > 1]
        none = lambda t: pa.nulls(len(tokens), t)
        held.clear()
        seen.clear()
        return pa.RecordBatch.from_arrays([none(pa.int64()), none(pa.int64()), none(pa.binary()), none(pa.binary()), pa.array(tokens, pa.int64()), pa.array(n, pa.int64())], names)

    names = ["doc_id", "n", "fp", "bits", "token", "df"]
    for b in batches:
        sizes, fps, bits = [], [], []
        for text in b.column(1).to_pylist():
            s = shingle_set(text, words)
            sizes.append(len(s))
            fps.append(fingerprint(s))
            bits.append(parity(s))
            if len(s) and fps[-1] not in seen:
                seen.add(fps[-1])
                held.append(s)
        none = pa.nulls(len(sizes), pa.int64())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(fps, pa.binary()), pa.array(bits, pa.binary()), none, none], names)
        if sum(map(len, held)) > COUNT_TOKENS:
            yield repeated()
    yield repeated()


class Join:
    """One run of the join over ``docs``; its tables lie in the shared folder."""

    def __init__(self, docs: DataFrame) -> None:
        self.spark = docs.sparkSession
        self.rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
        scanned = stored(map_arrow(self.rows, _sets, "doc_id long, n long, fp binary, bits binary, token long, df long"))
        self.docs = scanned.where("fp is not null").select("doc_id", "n", "fp")
        total = self.docs.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        floor = max(FREQUENT, total // MAX_FREQUENT)
        often = scanned.where("fp is null").groupBy("token").agg(F.sum("df").alias("df")).where(F.col("df") >= floor).select("token")
        self.frequent = np.sort(often.toArrow().column(0).to_numpy().astype(np.int64).view(np.uint64))  # at most MAX_FREQUENT
        self.classes = stored(scanned.where("fp is not null").where("n > 0 and doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("bits").alias("bits")))
        self.shared = self._shared()

    def _signed(self, texts: DataFrame, hot: np.ndarray) -> DataFrame:
        """sig, fp and salt of each signature of each set; the salt is 0 but for signatures in ``hot``."""
        known = self.spark.sparkContext.broadcast((self.frequent, hot))

        def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words, seen = WordIds(), set()
            frequent, hot = known.value
            for b in batches:
                sigs, fps, salts = [], [], []
                for text in b.column(0).to_pylist():
                    s = shingle_set(text, words)
                    fp = fingerprint(s)
                    if not len(s) or fp in seen:
                        continue
                    if len(seen) > 200_000:
                        seen.clear()
                    seen.add(fp)
                    sigs.append(signatures(s, frequent))
                    fps.append(fp)
                    if len(hot):
                        place = np.minimum(np.searchsorted(hot, sigs[-1]), len(hot) - 1)
                        salts.append((hot[place] == sigs[-1]).astype(np.int32) * np.int32(1 + fp[0] % SALTS))
                each = [len(x) for x in sigs]
                raw = b"".join(f * n for f, n in zip(fps, each, strict=True))
                fixed = pa.Array.from_buffers(pa.binary(16), sum(each), [None, pa.py_buffer(raw)]).cast(pa.binary())
                salt = np.concatenate(salts) if salts else np.zeros(sum(each), np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs).view(np.int64) if sigs else [], pa.int64()), fixed, pa.array(salt, pa.int32())], ["sig", "fp", "salt"])

        return map_arrow(texts, sign, "sig long, fp binary, salt int")

    def _shared(self) -> DataFrame:
        """sig, fp, salt and members of every signature that several sets have; a hot one's rows lie in many parts."""
        texts = self.rows.where("doc_id is not null").select("text")
        some = self._signed(texts.where(F.pmod(F.xxhash64("text"), F.lit(HOT_SHARE)) == 0), np.zeros(0, np.uint64))
        most = some.groupBy("sig").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= HOT).orderBy(F.desc("n"), "sig").limit(MAX_HOT)
        hot = np.sort(most.select("sig").toArrow().column(0).to_numpy().astype(np.int64).view(np.uint64))
        # The same set is signed once in each task: distinct before counting, both by the signature's partition.
        keys = ["sig", "salt"]
        once = self._signed(texts, hot).repartition(*keys).dropDuplicates([*keys, "fp"])
        members = F.count(F.lit(1)).over(W.partitionBy(*keys))
        kept = once.withColumn("members", members).where("members > 1 or salt > 0")
        kept = self.shared_files = stored(kept)
        if not len(hot):
            return kept
        counts = kept.where("salt > 0").groupBy("sig").agg(F.count(F.lit(1)).alias("all")).where(F.col("all") > 1)  # at most MAX_HOT rows
        dealt = kept.where("salt > 0").drop("members").join(F.broadcast(counts), "sig").select("sig", "salt", "fp", F.col("all").alias("members"))
        return kept.where("salt = 0").select("sig", "salt", "fp", "members").union(dealt)

    def possible(self, pairs: DataFrame) -> DataFrame:
        """Those of ``pairs`` (a, b: fingerprints) whose bitmaps don't rule a link out."""

        def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.select(["a", "b"]).filter(pa.array([may_link(*x) for x in zip(*(b.column(k).to_pylist() for k in range(2, 6)), strict=True)], pa.bool_()))

        pairs = if_small(pairs, pairs.count())
        for key in "ab":
            side = self.classes.select(F.col("fp").alias(key), F.col("n").alias(f"n{key}"), F.col("bits").alias(f"bits{key}"))
            pairs = side.join(pairs, key)
        return stored(map_arrow(pairs.select("a", "b", "na", "bitsa", "nb", "bitsb"), check, "a binary, b binary"))

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Those of ``pairs`` (a, b: fingerprints; a one of few hubs) that link."""
        n = pairs.count()
        hubs = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / HUB_PAIRS).alias("salts"))
        salted = stored(pairs.join(hubs, "a").select("a", "b", F.pmod(F.xxhash64("b"), "salts").alias("salt")))
        needed = stored(salted.select(F.col("a").alias("fp")).union(salted.select("b")).distinct().join(self.classes, "fp").select("fp", F.col("rep").alias("doc_id")))

        def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words = WordIds()
            for b in batches:
                sets = [shingle_set(t, words) for t in b.column(1).to_pylist()]
                kept = [s.tobytes() if fingerprint(s) == fp else None for s, fp in zip(sets, b.column(0).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(kept, pa.binary())], ["fp", "tokens"])

        rows = self.rows.join(if_small(needed, min(2 * n, needed.count())), "doc_id").select("fp", "text")
        sets = stored(map_arrow(rows, rebuild, "fp binary, tokens binary").where("tokens is not null"))
        heads = salted.select("a", "salt").distinct().withColumn("b", F.lit(None).cast("binary"))
        lists = [side.join(sets.withColumnRenamed("fp", key), key).select("a", "salt", "b", "tokens") for side, key in ((if_small(heads, n), "a"), (if_small(salted, n), "b"))]

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hub, tokens = None, np.zeros(0, np.uint64)
            for batch in batches:
                out: list[tuple[bytes, bytes]] = []
                for a, b, raw in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                    s = np.frombuffer(raw, np.uint64)
                    if b is None:
                        hub, tokens = a, s
                    elif a == hub and links(tokens, s):
                        out.append((a, b))
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.binary()) for k in (0, 1)], ["a", "b"])

        together = lists[0].union(lists[1]).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first()).select("a", "b", "tokens")
        out = stored(map_arrow(together, compare, "a binary, b binary"))
        for done in (sets, salted, needed):
            discard(done)
        return out

    def hub_groups(self) -> DataFrame:
        """hub and fp: for each set the hubs of its signatures, a hub the set of most shared signatures (itself included)."""
        scores = stored(self.shared.groupBy("fp").agg(F.sum("members").alias("score")))
        rows = self.shared.select("sig", "fp", "salt").join(if_small(scores, scores.count()), "fp")
        best = F.max(F.struct("score", "fp"))
        cold = rows.where("salt = 0").select(best.over(W.partitionBy("sig"))["fp"].alias("hub"), "fp")
        hot = rows.where("salt > 0")
        hubs = hot.groupBy("sig").agg(best["fp"].alias("hub"))
        return stored(cold.union(hot.join(F.broadcast(hubs), "sig").select("hub", "fp")).distinct())  # at most MAX_HOT rows

    def apart(self, groups: DataFrame, labels: DataFrame) -> DataFrame:
        """a, b: all pairs of a hub's group that ``labels`` doesn't join yet and whose bitmaps don't rule a link out.

        A group is dealt by its sets' sizes into blocks of about ``GROUP_BLOCK`` sets, and each pair of blocks whose sizes
        allow a link is a cell of its own that one task tests, so a group of any size is spread, a cell's rows are bounded
        and no set is sent to a cell where all others are too large or small; only pairs that pass leave the task. Joins
        by hub are salted.
        """
        salt = F.pmod(F.xxhash64("fp"), F.lit(SALTS)).alias("salt")
        named = groups.join(labels, "fp", "left").select("hub", "fp", F.coalesce("label", "fp").alias("label"), salt)
        open_ = named.groupBy("hub").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("m")).where("lo != hi")
        every_salt = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt")
        open_ = stored(open_.select("hub", "m"))
        dealt = named.join(open_.select("hub", "m", every_salt), ["hub", "salt"]).drop("salt")
        cells = dealt.where(F.col("m") <= GROUP_BLOCK).select("hub", *[F.lit(0).alias(c) for c in ("x", "y", "own")], "fp", "label")
        if open_.where(F.col("m") > GROUP_BLOCK).isEmpty():
            return self._tested(cells)
        large = stored(dealt.where(F.col("m") > GROUP_BLOCK).join(self.classes.select("fp", "n"), "fp").select("hub", "fp", "label", "n", F.floor(F.log2("n") * SIZE_STEPS).cast("int").alias("step")))
        # Steps of sizes are put together to blocks in order; a step of many sets is several blocks, its sets dealt by hash.
        steps = large.groupBy("hub", "step").agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("lo"), F.max("n").alias("hi"))
        upto = F.sum("k").over(W.partitionBy("hub").orderBy("step").rowsBetween(W.unboundedPreceding, -1))
        steps = steps.withColumn("first", F.floor(F.coalesce(upto, F.lit(0)) / GROUP_BLOCK).cast("int")).withColumn("parts", F.ceil(F.col("k") / GROUP_BLOCK).cast("int"))
        steps = stored(steps)
        parts = steps.select("hub", "lo", "hi", F.explode(F.sequence("first", F.col("first") + F.col("parts") - 1)).alias("block"))
        blocks = parts.groupBy("hub", "block").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        other = blocks.toDF("hub", "other", "other_lo", "other_hi")
        # Sizes of two blocks allow a link if the larger block's least size is within reach of the smaller's greatest.
        reach = (F.col("other_hi") * 100 >= F.col("lo") * PERCENT) & (F.col("hi") * 100 >= F.col("other_lo") * PERCENT)
        partners = blocks.join(other, "hub").where(reach).groupBy("hub", "block").agg(F.collect_list("other").alias("others"))
        placed = large.join(if_small(steps.select("hub", "step", "first", "parts"), steps.count()), ["hub", "step"])
        placed = placed.select("hub", "fp", "label", (F.col("first") + F.pmod(F.xxhash64("fp"), "parts").cast("int")).alias("own"))
        spread_out = placed.join(partners.withColumnRenamed("block", "own"), ["hub", "own"]).withColumn("other", F.explode("others"))
        return self._tested(cells.union(spread_out.select("hub", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "fp", "label")))

    def _tested(self, cells: DataFrame) -> DataFrame:
        """a, b: the pairs within ``cells`` (hub, x, y, own, fp, label) that ``cell_pairs`` leaves."""
        cells = cells.join(self.classes.select("fp", "n", "bits"), "fp")

        def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[tuple] = []
            for b in batches:
                out: list[tuple[bytes, bytes]] = []
                for row in zip(*(b.column(k).to_pylist() for k in range(8)), strict=True):
                    if held and row[:3] != held[0][:3]:
                        out += cell_pairs(held)
                        held = []
                    held.append(row)
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.binary()) for k in (0, 1)], ["a", "b"])
            out = cell_pairs(held) if held else []
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.binary()) for k in (0, 1)], ["a", "b"])

        together = cells.repartition("hub", "x", "y").sortWithinPartitions("hub", "x", "y").select("hub", "x", "y", "own", "fp", "label", "n", "bits")
        return stored(map_arrow(together, test, "a binary, b binary").distinct())

    def labels(self) -> DataFrame:
        """fp and label (the smallest fingerprint of its component) of every set that links with another."""
        groups = self.hub_groups()
        discard(self.shared_files)
        near = F.least("n", "hub_n") * 100 >= F.greatest("n", "hub_n") * PERCENT
        sizes = self.classes.select("fp", "n")
        starred = groups.where("hub != fp").join(sizes, "fp").join(sizes.toDF("hub", "hub_n"), "hub").where(near)
        edges = self.verified(self.possible(starred.select(F.col("hub").alias("a"), F.col("fp").alias("b"))))
        more = self.verified(self.apart(groups, components(edges)))
        return components(edges.union(more))


def components(edges: DataFrame) -> DataFrame:
    """fp and label of all nodes of ``edges`` (a, b): label is the least node of its connected component.

    Each turn takes the least label of all neighbours, then the label of that label, until none changes.
    """
    both = stored(edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = stored(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("fp"), F.least("a", "m").alias("label")))
    n = labels.count()  # of all tables below
    while True:
        near = both.join(if_small(labels.select(F.col("fp").alias("b"), "label"), n), "b").groupBy("a").agg(F.min("label").alias("m"))
        least = labels.join(if_small(near.withColumnRenamed("a", "fp"), n), "fp").select("fp", F.least("label", "m").alias("label"), F.col("label").alias("old"))
        least = stored(least)
        jumped = least.join(if_small(least.select(F.col("fp").alias("label"), F.col("label").alias("far")), n), "label").select("fp", F.least("label", "far").alias("label"), "old")
        jumped = stored(jumped)
        labels = jumped.select("fp", "label")
        if jumped.where("label != old").isEmpty():
            return labels


def fingerprints(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with the fingerprint of each text's set, which is its class, as column ``name``."""
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordIds()
        for b in batches:
            fps = [fingerprint(shingle_set(t or "", words)) for t in b.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(fps, pa.binary())], [*b.schema.names, name])

    plain = plain_names(docs)
    return map_arrow(plain, run, StructType([*plain.schema.fields, StructField(name, BinaryType())])).toDF(*docs.columns, name)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs`` (doc_id, text; other columns are ignored).

    component_id is the smallest doc_id reachable by links, the document's own included. Null and empty
    texts have 0 shingles and link with nothing; with fewer than five words the whole text is the one
    shingle. Rows without doc_id link with nothing and have no component. Repeated rows are one class.
    """
    return classified(docs).select("doc_id", "n_shingles", "component_id")


def classified(docs: DataFrame) -> DataFrame:
    """``near_duplicates`` with fp, the text's class, and label, the least fp of its component.

    Where an id has several texts, components can share their smallest id, so only label tells them apart.
    """
    join = Join(docs)
    labels = join.labels()
    linked = stored(join.classes.join(if_small(labels, labels.count()), "fp").select("fp", "label", "rep"))
    least = linked.groupBy("label").agg(F.min("rep").alias("component_id"))
    # A component may be large, so its members aren't dealt by it where the components' own table is small.
    own_least = linked.join(if_small(least, least.count()), "label").select("fp", "label", "component_id")
    named = join.classes.join(own_least, "fp", "left").select("fp", "label", F.coalesce("component_id", "rep").alias("component_id"))
    joined = join.docs.join(named, "fp", "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce(F.when(F.col("n") > 0, F.col("component_id")), F.col("doc_id")))
    return joined.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), "fp", F.coalesce("label", "fp").alias("label"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
