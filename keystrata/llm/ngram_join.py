"""N-gram Jaccard join through a matrix of tokens and groups."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keystrata.llm.common import marked, saved, ship, trimmed
from keystrata.llm.components import components

#: Bits of the bitmap of tokens; its size is fixed whatever the input.
HOT_BITS = 22
#: A token that more sets than this have among their first tokens is looked up after all others.
WIDE = 64
#: Sets a group has on average, at most, and their tokens.
GROUP_SETS, GROUP_TOKENS = 128, 1 << 19
#: Sets and tokens of a block into which groups that belong together are dealt anew.
BLOCK_SETS, BLOCK_TOKENS = 128, 1 << 19
#: Groups of a token beyond which they are cut into tiles, and the tiles meet pair by pair.
PAIRED_GROUPS = 1024
#: Tokens of more sets than this are counted by matrix products, others pair by pair.
RARE = 16
#: Sets of one group differ in size by less than this factor.
SIZE_STEP = 1.1
#: Share of its tokens by which a set's prefix is longer than one shared token asks for; so much
#: more must be shared.
EXTRA_PERCENT = 5
#: Bits of a group's id that state its size class.
CLASS_BITS = 9


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Distinct shingles of ``k`` words as ascending 63-bit hashes; a shorter text is one shingle.

    Words are runs of characters that are not ``[\\x20\\x09-\\x0D]``, A-Z in lower case.
    """
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.int64)
    if len(words) < k:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words)) >> 1], np.int64)
    each = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    mixed = np.zeros(len(words) - k + 1, np.uint64)
    for i in range(k):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + each[i : i + len(mixed)]
        mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    return np.unique((mixed >> np.uint64(1)).astype(np.int64))


def must_share(n: int) -> int:
    return 1 + n * EXTRA_PERCENT // 100


def kept_length(n: int, num: int, den: int) -> int:
    """Tokens kept of a set: its prefix and a third more, to make up for tokens of many sets."""
    length = prefix_length(n, num, den)
    return min(n, length + length // 3 + 2)


def prefix_length(n: int, num: int, den: int) -> int:
    """Tokens of which two sets of ``n`` or more that reach the threshold share ``must_share(n)``, in any common order."""
    return min(n, n - -(-num * n // den) + must_share(n))


def _often(tokens: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Which tokens are in a bitmap."""
    cell = tokens & ((1 << HOT_BITS) - 1)
    return (hot[cell >> 6] >> (cell & 63).astype(np.uint64)) & np.uint64(1) == 1


def in_order(tokens: np.ndarray, hot: np.ndarray, sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens in the order common to all sets, and their levels: by level, then by hash.

    Tokens outside the bitmap have level 0.  Those in it have 1, or the least that a row of
    ``sketch`` says of them, where this is more.
    """
    level = np.ones(len(tokens), np.int8)
    np.maximum(level, np.min([row[cell] for row, cell in zip(sketch, _cells(tokens), strict=True)], axis=0), out=level)
    level[~_often(tokens, hot)] = 0
    order = np.lexsort((tokens, level))
    return tokens[order], level[order]


def _cells(tokens: np.ndarray | Column) -> list:
    """A token's cell in each row of the sketch of levels: its lowest bits, and those above them."""
    high = F.shiftright(tokens, HOT_BITS) if isinstance(tokens, Column) else tokens >> HOT_BITS
    mask = (1 << HOT_BITS) - 1
    return [x.bitwiseAND(mask) if isinstance(x, Column) else x & mask for x in (tokens, high)]


def _level_sketch(levels: DataFrame) -> np.ndarray:
    """Two rows of ``2**HOT_BITS`` levels, whatever the input: of each cell the greatest level of its tokens.

    What the rows say of a token is never less than its level, and more only where others share its cell in both.
    """
    out = np.zeros((2, 1 << HOT_BITS), np.int8)
    for row, cell in zip(out, _cells(F.col("token")), strict=True):
        cells = levels.groupBy(cell.cast("int").alias("cell")).agg(F.max("level").alias("level")).toArrow()
        row[cells["cell"].to_numpy()] = cells["level"].to_numpy()
    return out


def group_key(tokens: np.ndarray, level: np.ndarray) -> int:
    """The token that names a set's group: the first, or of least hash among those of many sets where
    these are the greater part, so that what a copy of a common text changes does not set it apart."""
    common = tokens[level > 1]
    return int(common.min() if 2 * len(common) >= len(tokens) else tokens[0])


def _bitmap(cells: DataFrame, bits: int) -> np.ndarray:
    """A bitmap of ``2**bits`` bits from a column ``cell``; at most ``2**(bits - 6)`` rows reach the driver."""
    words = (
        cells.groupBy(F.shiftright("cell", 6).cast("int").alias("word"))
        .agg(F.expr("bit_or(shiftleft(1L, cast(cell & 63 as int)))").alias("bits"))
        .collect()
    )
    out = np.zeros(1 << (bits - 6), np.uint64)
    for word, value in words:
        out[word] = value & ((1 << 64) - 1)
    return out


def _token_bitmap(tokens: DataFrame) -> np.ndarray:
    return _bitmap(tokens.select(F.col("token").bitwiseAND((1 << HOT_BITS) - 1).alias("cell")), HOT_BITS)


def _lists(rows: list[np.ndarray], kind: type = np.int64) -> pa.ListArray:
    offsets = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(offsets, np.concatenate(rows) if rows else np.empty(0, kind))


def _sets(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Per row its set's size and digest, and the first of its tokens in the order of hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        from keystrata.llm.ngram_join import _lists, kept_length, shingle_set

        for batch in batches:
            sizes, digests, kept = [], [], []
            for text in batch.column(2):
                tokens = shingle_set(text.as_py(), k)
                n = len(tokens)
                sizes.append(n)
                digests.append(xxhash.xxh3_128_digest(tokens.tobytes()))
                kept.append(tokens[: kept_length(n, num, den)] if n else tokens)
            made = [pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), _lists(kept)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *made], ["key", "doc_id", "n", "digest", "tokens"])

    return docs.select("key", "doc_id", "text").mapInArrow(trimmed(run), "key string, doc_id bigint, n bigint, digest binary, tokens array<bigint>")


def _prefixes(classes: DataFrame, hot: np.ndarray, num: int, den: int) -> DataFrame:
    """Per set its prefix of tokens outside the bitmap (sid, key, first, tokens), and whether the kept
    tokens are too few for it (``short``); its levels are 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from keystrata.llm.ngram_join import _lists, _often, prefix_length

        for batch in batches:
            prefixes, short = [], []
            own = batch.column(3)
            flat, ends = own.flatten().to_numpy(), np.append(0, np.cumsum(own.value_lengths().to_numpy(zero_copy_only=False)))
            rare = ~_often(flat, hot)
            for i, n in enumerate(batch.column(2).to_pylist()):
                left = flat[ends[i] : ends[i + 1]][rare[ends[i] : ends[i + 1]]]
                length = prefix_length(n, num, den)
                short.append(len(left) < length)
                prefixes.append(left[: 0 if short[-1] else length])
            made = [pa.array([int(x[0]) if len(x) else None for x in prefixes], pa.int64()), _lists(prefixes), pa.array(short, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *made], ["sid", "key", "first", "tokens", "short"])

    return classes.select("sid", "key", "n", "tokens").mapInArrow(trimmed(run), "sid bigint, key string, first bigint, tokens array<bigint>, short boolean")


def _chosen(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose key is among ``keys``, and few others: a bitmap drops most before any shuffle."""
    found = marked(docs.select("key", "text"), F.xxhash64("key"), keys.select(F.xxhash64("key").alias("cell")), "key-bits")
    return found.where("marked").drop("marked")


def _levels(texts: DataFrame, k: int) -> DataFrame:
    """Tokens of more than ``WIDE`` of these texts, with the logarithm of their number as level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from keystrata.llm.ngram_join import shingle_set

        held, n = [], 0

        def flush() -> pa.RecordBatch:
            tokens, counts = np.unique(np.concatenate(held or [np.empty(0, np.int64)]), return_counts=True)
            return pa.RecordBatch.from_pydict({"token": tokens, "n": counts})

        for batch in batches:
            for text in batch.column(0):
                held.append(shingle_set(text.as_py(), k))
                n += len(held[-1])
                if n > 1 << 18:
                    yield flush()
                    held, n = [], 0
        yield flush()

    counts = texts.select("text").mapInArrow(trimmed(run), "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n"))
    return counts.where(F.col("n") > WIDE).select("token", F.floor(F.log2("n")).cast("tinyint").alias("level"))


def _ordered(docs: DataFrame, classes: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The prefix of every set in the order common to all: (sid, first, tokens, levels).

    The order is by level, then by hash.  Level 0 are the tokens outside a bitmap of fixed size.
    It holds those that more than ``WIDE`` sets have among their kept tokens, all counted.  Most
    sets have enough tokens of level 0 among the kept ones.  Of the others all tokens are
    counted, those of more than ``WIDE`` such sets are put into the bitmap too, and the logarithm
    of their number is their level.  Every task that orders sets short of tokens has the levels
    in a sketch of fixed size, so that no row is made for a token of a set.
    A full bitmap makes all sets short; the sketch, not the bitmap, then gives the order.
    """
    counts = classes.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    wide = saved(counts.where(F.col("n") > WIDE).select("token"), "wide-tokens")
    first = _prefixes(classes, _token_bitmap(wide), num, den).where("short").select("key")
    levels = saved(_levels(_chosen(docs, first), k), "token-levels")
    hot = _token_bitmap(wide.unionByName(levels.select("token")))
    made = saved(_prefixes(classes, hot, num, den), "prefixes")
    sketch = _level_sketch(levels)

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from keystrata.llm.ngram_join import _lists, group_key, in_order, prefix_length, shingle_set

        for batch in batches:
            firsts, prefixes, steps = [], [], []
            for text in batch.column(1):
                tokens, level = in_order(shingle_set(text.as_py(), k), hot, sketch)
                firsts.append(group_key(tokens, level))
                length = prefix_length(len(tokens), num, den)
                prefixes.append(tokens[:length])
                steps.append(level[:length])
            made = [pa.array(firsts, pa.int64()), _lists(prefixes), _lists(steps, np.int8)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], ["sid", "first", "tokens", "levels"])

    short = made.where("short").select("sid", "key")
    joined = _chosen(docs, short).join(short, "key").select("sid", "text")
    anew = saved(joined.mapInArrow(trimmed(order), "sid bigint, first bigint, tokens array<bigint>, levels array<tinyint>"), "late-prefixes")
    none = F.lit(None).cast("array<tinyint>").alias("levels")
    # a row that is repeated comes twice, and its postings count once
    return made.where("NOT short").select("sid", "first", "tokens", none).unionByName(anew)


def _group_pairs(postings: DataFrame, apart: int, paired: int = PAIRED_GROUPS) -> DataFrame:
    """Pairs of groups (g, h) of near size that share as many tokens of the matrix as a link asks for.

    Takes gid, token, level.  Size classes differ by ``apart`` at most; the lesser class bounds
    what its smallest set must share.  The groups of a token with a level are cut into tiles of
    about ``paired``, and every two tiles meet in a unit of their own, so that no token is one
    task's work.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = (1 << CLASS_BITS) - 1
        found: list[np.ndarray] = []
        size = 0

        def emit() -> pa.RecordBatch:
            pairs = np.concatenate(found or [np.empty((0, 2), np.int64)])
            pairs.sort(axis=1)
            pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
            at = np.flatnonzero(np.concatenate([[True], (pairs[1:] != pairs[:-1]).any(axis=1)])[: len(pairs)])
            counts = np.diff(np.append(at, len(pairs))).astype(np.int64)
            return pa.RecordBatch.from_pydict({"g": pairs[at, 0], "h": pairs[at, 1], "shared": counts})

        def add(g: np.ndarray, h: np.ndarray) -> Iterator[pa.RecordBatch]:
            nonlocal found, size
            near = (np.abs((g & classes) - (h & classes)) <= apart) & (g != h)
            if near.any():
                found.append(np.stack([g[near], h[near]], axis=1))
                size += int(near.sum())
                if size > 1 << 18:
                    yield emit()
                    found, size = [], 0

        def units(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            """``rows`` are (token, part, side, gid), sorted, of whole units (token, part)."""
            if len(rows) < 2:
                return
            rows = rows[np.append(True, (rows[1:] != rows[:-1]).any(axis=1))]
            begins = np.flatnonzero(np.append(True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1)))
            unit = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(rows))))
            group, across = rows[:, 3], np.zeros(len(begins), bool)
            across[unit[rows[:, 2] == 1]] = True
            for one in np.flatnonzero(across):
                own = rows[begins[one] : begins[one + 1] if one + 1 < len(begins) else len(rows)]
                left, right = own[own[:, 2] == 0, 3], own[own[:, 2] == 1, 3]
                yield from add(np.repeat(left, len(right)), np.tile(right, len(left)))
            step, at = 1, np.flatnonzero(~across[unit])
            while len(at := at[at + step < len(rows)]) and len(at := at[unit[at] == unit[at + step]]):
                yield from add(group[at], group[at + step])
                step += 1

        rows = np.empty((0, 4), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.concatenate([rows, np.stack([c.to_numpy() for c in batch.columns], axis=1)])
            whole = int(np.flatnonzero((rows[:, :2] == rows[-1, :2]).all(axis=1))[0])
            yield from units(rows[:whole])
            rows = rows[whole:]
        yield from units(rows)
        yield emit()

    none = F.lit(0).cast("bigint")
    late = postings.where("level > 0")
    widths = late.groupBy("token").agg(F.ceil(F.count("*") / paired).alias("tiles"))
    own, other, tiles = F.pmod(F.xxhash64("gid"), F.col("tiles")), F.col("other"), F.col("tiles")
    tiled = (
        late.join(widths, "token")
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), tiles - 1)))
        .select("token", (F.least("own", "other") * tiles + F.greatest("own", "other")).alias("part"), (F.col("own") > other).cast("bigint").alias("side"), "gid")
    )
    plain = postings.where("level = 0").select("token", none.alias("part"), none.alias("side"), "gid")
    ordered = plain.unionByName(tiled).repartition("token", "part").sortWithinPartitions("token", "part", "side", "gid")
    counted = ordered.mapInArrow(trimmed(run), "g bigint, h bigint, shared bigint").groupBy("g", "h").agg(F.sum("shared").alias("shared"))
    mask = F.lit((1 << CLASS_BITS) - 1)
    smallest = F.pow(F.lit(SIZE_STEP), F.least(F.col("g").bitwiseAND(mask), F.col("h").bitwiseAND(mask))) * (1 - 1e-9)
    return counted.where(F.col("shared") >= 1 + F.floor(smallest * EXTRA_PERCENT / 100)).select("g", "h")


#: Sets as (number, tokens, documents that have this set).
Sets = list[tuple[int, np.ndarray, int]]


def _overlaps(sets: list[np.ndarray], columns: int = 1 << 13) -> np.ndarray:
    """Tokens shared by every set with every later one, as an upper triangle.

    Tokens of a single set fall out, those of a few sets are counted pair by pair, and frequent
    ones by products of 0/1 matrices, for so many columns (tokens) at a time.
    """
    many = len(sets)
    token = np.concatenate(sets)
    row = np.repeat(np.arange(many), [len(s) for s in sets])
    order = np.argsort(token, kind="stable")
    token, row = token[order], row[order]
    begins = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
    counts = np.diff(np.append(begins, len(token)))
    place = np.repeat(np.arange(len(begins)), counts)
    spread = np.repeat(counts, counts)
    out = np.zeros((many, many))
    at = np.flatnonzero((spread > 1) & (spread <= RARE))
    step = 1
    while len(at := at[at + step < len(place)]) and len(at := at[place[at] == place[at + step]]):
        out += np.bincount(row[at] * many + row[at + step], minlength=many * many).reshape(many, many)
        step += 1
    frequent = spread > RARE
    number = np.cumsum(counts > RARE) - 1
    row, place = row[frequent], number[place[frequent]]
    for start in range(0, int(number[-1]) + 1, columns):
        a, b = np.searchsorted(place, [start, start + columns])
        part = np.zeros((many, min(columns, int(number[-1]) + 1 - start)), np.float32)
        part[row[a:b], place[a:b] - start] = 1
        out += np.triu(part @ part.T, 1)
    return out


def links(left: Sets, right: Sets | None, num: int, den: int) -> tuple[list[tuple[int, int]], dict[int, int]]:
    """Links between two groups' sets, or within ``left`` where there is no ``right``.

    Gives the links that connect what none before them does, for the components, and for every
    set the documents of all sets it links with.
    """
    own = right is None
    right = left if own else right
    if not own and left and right:
        # so many of a set's tokens must be among the group's, or the group stays shut to it
        union = np.unique(np.concatenate([s for _, s, _ in right]))
        least = min(len(s) for _, s, _ in right)
        left = [x for x in left if np.isin(x[1], union, assume_unique=True).sum() * (num + den) >= num * (len(x[1]) + least)]
    if not left or not right:
        return [], {}
    both = _overlaps([s for _, s, _ in (left if own else [*left, *right])])
    both = both if own else both[: len(left), len(left) :]
    sizes = np.array([len(s) for _, s, _ in left])[:, None] + np.array([len(s) for _, s, _ in right])[None]
    linked = both * den >= num * (sizes - both)
    ends = [(d, int(n)) for d, n in zip([d for d, _, _ in left], linked @ np.array([c for _, _, c in right]), strict=True) if n]
    ends += [(d, int(n)) for d, n in zip([d for d, _, _ in right], np.array([c for _, _, c in left]) @ linked, strict=True) if n]
    counts: dict[int, int] = {}
    for d, n in ends:
        counts[d] = counts.get(d, 0) + n
    root = {d: d for d, _, _ in (*left, *right)}

    def top(d: int) -> int:
        while root[d] != d:
            root[d] = root[root[d]]
            d = root[d]
        return d

    out = []
    for i, j in zip(*np.nonzero(linked), strict=True):
        q, x = left[i][0], right[j][0]
        if top(q) != top(x):
            root[top(q)] = top(x)
            out.append((q, x))
    return out, counts


def _verified(opened: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Links of everything opened: rows are (g, h, part, side, sid, copies, text).

    Rows of one (g, h, part) are a pair of groups (part -1) or of blocks (h, part); where both
    are the same it is one, by itself.  Gives (a, b, links): links that connect, of which
    ``links`` is 0, and for a set ``a`` = ``b`` the documents it links with in a pair.
    Rows that repeat a set count once.  Tasks are ranges of pairs with about as many rows each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from keystrata.llm.ngram_join import links, shingle_set

        pair, sides, found, counted = None, ([], []), [], {}

        def close() -> None:
            if pair is None:
                return
            g, h, part = pair
            left, right = sides
            # a block may be empty, so it is not the rows that tell a pair from one by itself
            connecting, counts = links(left, None if h == (g if part < 0 else part) else right, num, den)
            found.extend(connecting)
            for d, n in counts.items():
                counted[d] = counted.get(d, 0) + n

        def emit() -> pa.RecordBatch:
            rows = [(a, b, 0) for a, b in found] + [(d, d, n) for d, n in counted.items()]
            a, b, n = zip(*rows, strict=True) if rows else ((), (), ())
            return pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "links": pa.array(n, pa.int64())})

        for batch in batches:
            for g, h, part, side, doc, copies, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (g, h, part) != pair:
                    close()
                    pair, sides = (g, h, part), ([], [])
                    if len(found) + len(counted) > 1 << 16:
                        yield emit()
                        found.clear()
                        counted.clear()
                if not any(d == doc for d, _, _ in sides[side][-1:]):
                    sides[side].append((doc, shingle_set(text, k), copies))
        close()
        yield emit()

    keys = ["g", "h", "part"]
    ordered = opened.select(*keys, "side", "sid", "copies", "text").repartitionByRange(*keys).sortWithinPartitions(*keys, "side", "sid")
    return ordered.mapInArrow(trimmed(run), "a bigint, b bigint, links bigint")


def jaccard_classes(docs: DataFrame, *, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Classes of documents connected by links: shingle sets with den * common >= num * united.

    1. One pass makes every row's set: its size, digest and first tokens by hash.  Equal sets become
       one, by digest, combined map-side: copies never meet in pairs.
    2. Tokens come in one order for all sets: those of few sets by hash, then those of many by
       the logarithm of their number, all counted (``_ordered``); a prefix is the first of them.
    3. Sets are put into groups of at most about 128 by size class and their token of least hash
       (of least hash among common ones, where these prevail), which similar sets mostly share.
       Large groups are cut by hash.
    4. The matrix holds, for each token of a set's prefix, the set's group.  Two sets that reach
       the threshold share a twentieth of the smaller one's tokens, and one more, in their
       prefixes, so every link lies within a group or between two groups of near size that share
       so many tokens of the matrix.
    5. Only such groups are opened; connected groups that are all near each other are dealt into
       blocks of 128 sets first, which are opened by pairs.  A set is compared with a group's members if enough of its
       tokens are in the group's union; overlaps are products of 0/1 matrices.
    6. Links are exact counts over whole sets, and all are counted; components follow by
       alternating stars from as many of them as connect a pair of groups.

    Texts are shuffled for opened groups and for sets of mostly common tokens only.
    Groups and blocks bound what a task holds: of a cluster of m near copies, (m / 128)**2 / 2
    pairs of blocks are opened, not m**2 / 2 pairs of rows.

    Null and empty texts have an empty set and link with nothing.  A text of fewer than ``k``
    words is one shingle.  Rows that share a doc_id but not a text are compared each by itself.
    Rows without a doc_id link like others but have no ``n_links`` and count in none; their
    component_id is null only if nobody they reach has an id.  An empty table gives an empty
    result.  Other columns are ignored.

    Returns doc_id, n_shingles, component_id (least doc_id of the class), n_links (other
    documents that reach the threshold with this one, those of an equal set included), key
    (names id and text) and stays (of each class the rows with the least doc_id, then least key).
    """
    ship(docs.sparkSession)
    docs = docs.select(row_key().alias("key"), F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    sets = saved(_sets(docs, k, num, den), "sets")
    own = sets.where("n > 0").groupBy("digest", "n")
    thin = own.agg(
        F.min("doc_id").alias("id"),
        F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("lead"),
        F.count_distinct("doc_id").alias("copies"),
    )
    # combined map-side, so that copies send one prefix a task
    prefixes = own.agg(F.first("tokens").alias("tokens"))
    classes = saved(
        thin.join(prefixes, ["digest", "n"])
        .withColumn("sid", F.monotonically_increasing_id())
        .withColumn("key", F.col("lead.key"))
        .withColumn("class", F.floor(F.log(SIZE_STEP, F.col("n"))).cast("bigint")),
        "classes",
    )
    ordered = _ordered(docs, classes, k, num, den)
    keyed = ordered.select("sid", "first").dropDuplicates(["sid"]).join(classes.select("sid", "key", "n", "copies", "class"), "sid")
    keyed = saved(keyed, "keyed")
    # groups that are cut, in a table of their own: a hot token of least hash is split where sets look it up
    many = F.greatest(F.ceil(F.count("*") / GROUP_SETS), F.ceil(F.sum("n") / GROUP_TOKENS))
    cuts = saved(keyed.groupBy("first", "class").agg(many.alias("cuts")).where("cuts > 1"), "cuts")
    part = F.pmod(F.xxhash64("sid"), F.coalesce("cuts", F.lit(1)))
    gid = F.shiftleft(F.xxhash64("first", "class", part), CLASS_BITS).bitwiseOR(F.col("class")).alias("gid")
    members = saved(keyed.join(cuts, ["first", "class"], "left").select("sid", "key", "n", "copies", gid), "groups")
    levels = F.coalesce("levels", F.transform("tokens", lambda _: F.lit(0).cast("tinyint")))
    postings = (
        ordered.select("sid", "tokens", levels.alias("levels"))
        .join(members.select("sid", "gid"), "sid")
        .select("gid", F.inline(F.arrays_zip(F.col("tokens").alias("token"), F.col("levels").alias("level"))))
    )
    # classes c and d hold sizes within the threshold of each other only if so near
    apart = math.floor(1 + math.log(den / num) / math.log(SIZE_STEP) + 1e-6)
    pairs = saved(_group_pairs(postings, apart), "group-pairs")
    opened = saved(_opened(members, pairs), "opened")
    edges = saved(_verified(opened.join(_chosen(docs, opened.select("key").distinct()), "key"), k, num, den), "links")
    counted = edges.where("a = b").groupBy(F.col("a").alias("sid")).agg(F.sum("links").alias("links"))
    found = components(edges.select("a", "b")).withColumnRenamed("node", "sid")
    labels = (
        classes.select("digest", "n", "sid", "id", "lead", "copies")
        .join(found, "sid", "left")
        .join(counted, "sid", "left")
        .withColumn("component", F.coalesce("component", "sid"))
        .withColumn("links", F.col("copies") - 1 + F.coalesce("links", F.lit(0)))
    )
    leads = labels.groupBy("component").agg(F.min("id").alias("component_id"), F.min("lead").alias("lead"))
    named = labels.drop("lead").join(leads, "component").select("digest", "n", "component_id", "links", F.col("lead.key").alias("lead"))
    return sets.select("key", "doc_id", "n", "digest").join(named, ["digest", "n"], "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.coalesce("component_id", "doc_id").alias("component_id"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("links", F.lit(0).cast("bigint"))).alias("n_links"),
        "key",
        F.coalesce(F.col("key") == F.col("lead"), F.lit(True)).alias("stays"),
    )


def row_key() -> Column:
    """A string that names a row by its id and its text's hash."""
    return F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(":"), F.xxhash64("text").cast("string"))


def _opened(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """Which sets meet: (g, h, part, side, sid, copies, key).

    Groups connected by pairs are dealt anew into blocks, all pairs of which are opened, if that
    sends fewer rows than opening their pairs of groups one by one; near copies are so, and a
    cluster that fits one block is sent once.  Of all other groups, the pairs and the groups
    with several members are opened.
    """
    found = components(pairs.select(F.col("g").alias("a"), F.col("h").alias("b"))).withColumnRenamed("node", "gid")
    sizes = members.groupBy("gid").agg(F.count("*").alias("sets"), F.sum("n").alias("tokens"))
    ends = pairs.select(F.col("g").alias("gid")).unionByName(pairs.select(F.col("h").alias("gid")))
    degrees = ends.groupBy("gid").agg(F.count("*").alias("degree"))
    blocks = F.greatest(F.ceil(F.col("sets") / BLOCK_SETS), F.ceil(F.col("tokens") / BLOCK_TOKENS))
    dealt = (
        sizes.join(found, "gid")
        .join(degrees, "gid")
        .groupBy("component")
        .agg(F.sum("sets").alias("sets"), F.sum("tokens").alias("tokens"), F.sum((F.col("degree") + 1) * F.col("sets")).alias("rows"))
        .withColumn("blocks", blocks)
        .where(F.col("sets") * F.col("blocks") <= F.col("rows"))
        .select("component", "blocks")
    )
    anew = saved(found.join(dealt, "component"), "blocks")
    own, other = F.pmod(F.xxhash64("sid"), F.col("blocks")), F.col("other")
    low, high = F.least("own", "other"), F.greatest("own", "other")
    kept = ["sid", "copies", "key"]
    in_blocks = (
        members.join(anew, "gid")
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
        .select(F.col("component").alias("g"), low.alias("h"), high.alias("part"), (F.col("own") > other).cast("int").alias("side"), *kept)
    )
    rest = pairs.join(anew.select(F.col("gid").alias("g")), "g", "left_anti")
    alone = sizes.where("sets > 1").join(anew, "gid", "left_anti").select(F.col("gid").alias("g"), F.col("gid").alias("h"))
    none = F.lit(-1).cast("bigint").alias("part")
    side = lambda df, end, n: df.join(members, F.col(end) == F.col("gid")).select("g", "h", none, F.lit(n).alias("side"), *kept)
    return in_blocks.unionByName(side(rest.unionByName(alone), "g", 0)).unionByName(side(rest, "h", 1))
