"""Near duplicates by MinHash: documents are posted under every coordinate of their signature.

A signature has ``COORDINATES`` minima; two texts agree in a coordinate as often as their
sets are alike. Texts that agree in fewer than ``LEAST_MATCHES`` are not looked at; one pair
in about 100,000 with the limit similarity itself does. What is left is confirmed on full sets.

Posts are keyed by coordinate and value. A post that nobody else holds can't match, so a
text with fewer shared posts than the threshold leaves at once. The others order their posts
from rare to frequent: two texts that agree in t of k stand together under one of the first
k - t + 1 posts of each, and only these prefixes are joined.

Pairs are not listed within a post. First every member is held against the heads of three of
its lists, then, where it is still apart from them, against those of all. Then lists that
still hold several components go to tasks, where the members outside of the largest one
count their collisions with all others whose first common post this is: the shortest lists
of a member are merged, the long ones are skipped and only asked about what is left, until
the threshold is out of reach. Short lists with the same smallest class go there together,
as a passage makes many lists with the same members. Whoever reaches it is compared by sets of short hashes, in the
same task, so that texts which share a passage and no more don't leave it as pairs. Lists have
a bounded length; longer ones are dealt to blocks. Of its pairs a block gives no more than
hold together what all of them would, so a group of near copies costs its size here too.
Where one of these is no link on full sets, what it held together may be linked by pairs that
were not given: such blocks are met again, by whole sets, where every pair found is a link.

What goes to blocks and pairs is short, as it goes there once for every list or pair: hashes
of 16 bits for a set, a byte for each coordinate of a prefix, and a byte of each minimum where
two signatures are held against each other. Short hashes can only add to an agreement; links
are confirmed on full sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annoframe.llm import shared
from annoframe.llm.components import components
from annoframe.llm.confirm import both_ends, linked
from annoframe.llm.words import NOT_SPACE, mixed, runs, whole, words_of

WIDTH = 2
COORDINATES = 64
LEAST_MATCHES = 38
PREFIX = COORDINATES - LEAST_MATCHES + 1
#: Members of a block of a list; longer lists are dealt to several blocks.
LIST_ROWS = 1024
#: Lists of up to so many members are met together with those of the same head; at most ``LIST_ROWS``.
SHORT_ROWS = 256
#: Rows of classes up to this number are broadcast once they are counted (32 bytes each); more are joined by shuffle.
BROADCAST_ROWS = 1_000_000
#: What names a block, and the pairs it gives.
BLOCK = ["__list", "__row", "__col"]
BLOCK_PAIRS = "__x long, __y long, __list long, __row long, __col long"
#: How hashes are cut where whole lists meet, and where a block is met again: bits, the same with a sign, and in SQL.
SETS = {"short": (np.uint16, np.int16, "smallint"), "whole": (np.uint64, np.int64, "long")}
_SLICE = 2 << 20
_FACTORS = np.random.default_rng(131).integers(1, 1 << 63, COORDINATES, np.uint64) * np.uint64(2) + np.uint64(1)
_MASKS = np.random.default_rng(137).integers(0, 1 << 63, COORDINATES, np.uint64)


def shingles_of(texts: pa.Array, width: int = WIDTH) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; NULL and texts without words have none."""
    _, _, hashes, firsts = words_of(*shared.utf8(texts), NOT_SPACE, lower=True)
    every = runs(hashes, width)
    for lo, hi in zip(firsts[:-1].tolist(), firsts[1:].tolist(), strict=True):
        if hi - lo >= width:
            yield np.unique(every[lo : hi - width + 1])
        else:
            yield whole(hashes[lo:hi]) if hi > lo else np.zeros(0, np.uint64)


def set_key(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that equal sets have in common."""
    if not len(shingles):
        return 0, 0
    a, b = np.add.reduce(mixed(shingles ^ np.uint64(0x5851F42D4C957F2D))), np.add.reduce(mixed(shingles * np.uint64(0xDA942042E4DD58B5)))
    return int(a.astype(np.int64)), int((b + np.uint64(len(shingles))).astype(np.int64))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """The minimum of every coordinate of every set, as 32 bits; sets are not empty."""
    flat = np.concatenate(sets)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]]).astype(np.int64)
    out = np.empty((len(sets), COORDINATES), np.uint32)
    for k in range(COORDINATES):
        out[:, k] = mixed(np.minimum.reduceat((flat ^ _MASKS[k]) * _FACTORS[k], starts)) >> np.uint64(32)
    return out


def _lists(values: list[np.ndarray], kind) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in values])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(values).astype(kind) if values else np.zeros(0, kind)))


def _signed(docs: DataFrame, id: str, text: str) -> DataFrame:
    """Id, set size, key of the set and signature of each row; a row without shingles has an empty signature."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in shared.slices(batch, text, _SLICE):
                sets = list(shingles_of(shared.column(piece, text)))
                keys = [set_key(s) for s in sets]
                full = [k for k, s in enumerate(sets) if len(s)]
                found = iter(signatures([sets[k] for k in full]).view(np.int32) if full else ())
                rows = [next(found) if len(s) else np.zeros(0, np.int32) for s in sets]
                columns = [[len(s) for s in sets], [a for a, _ in keys], [b for _, b in keys]]
                yield pa.RecordBatch.from_arrays([shared.column(piece, id), *(pa.array(x, pa.int64()) for x in columns), _lists(rows, np.int32)], names=["__id", "__size", "__a", "__b", "__sig"])

    return shared.in_batches(docs.select(id, text), sign, f"__id {dict(docs.dtypes)[id]}, __size long, __a long, __b long, __sig array<int>")


def collisions(signature: np.ndarray, lists: list[np.ndarray], matrix: np.ndarray, wanted: np.ndarray, least: int = LEAST_MATCHES) -> np.ndarray:
    """The wanted members that agree with a signature in ``least`` coordinates or more.

    ``lists`` are the members under each of its posts. Whoever agrees in so many stands in
    one of the shortest lists: these are merged and counted. The longer ones are skipped;
    each is only asked whether it holds those that can still reach the threshold.
    """
    order = sorted(range(len(lists)), key=lambda k: len(lists[k]))
    merged = len(lists) - least + 1
    counts = np.bincount(np.concatenate([lists[k] for k in order[:merged]]), minlength=len(matrix))
    left = np.flatnonzero((counts > 0) & wanted)
    have = counts[left]
    for done, k in enumerate(order[merged:]):
        can = have + (len(lists) - merged - done) >= least
        left, have = left[can], have[can]
        if not len(left):
            break
        have = have + (matrix[left, k] == signature[k])
    return left[have >= least]


def earlier_partners(prefixes: list[np.ndarray], post: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """The posts of all prefixes in order, who has each of them, and of every prefix what stands before ``post``."""
    own = np.repeat(np.arange(len(prefixes)), [len(p) for p in prefixes])
    flat = np.concatenate(prefixes)
    order = np.argsort(flat, kind="stable")
    return flat[order], own[order], [p[: int(np.flatnonzero(p == post)[0])] for p in prefixes]


def _within(flat: np.ndarray, each: np.ndarray, rows: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Of all elements of the rows' sets, whether they stand in ``own``, which is sorted."""
    lengths = np.diff(each)[rows]
    places = np.repeat(each[rows] - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
    values = flat[places]
    return own[np.minimum(np.searchsorted(own, values), len(own) - 1)] == values


def block_pairs(
    classes: np.ndarray, colors: np.ndarray, asks: np.ndarray, sizes: np.ndarray, matrix: np.ndarray, prefixes: list[np.ndarray], post: int | None, sets: list[np.ndarray],
    spanning: bool = False,
) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (smaller class, larger class) of members that ask and members of another color that agree often enough.

    Their sizes allow a link, of the posts that both prefixes hold ``post`` comes first (None:
    members of several lists, whose pairs may stand elsewhere too), and their sets of short
    hashes overlap enough; equal hashes can only add to that. ``spanning``: only so many of
    them that they join the same colors. A member gives its best pair with each color that it
    finds, and all of these are one color from then on.
    """
    colors = colors.copy()
    each = np.cumsum([0, *map(len, sets)])
    flat = np.concatenate(sets)
    inverted = []
    for k in range(matrix.shape[1]):
        order = np.argsort(matrix[:, k], kind="stable")
        inverted.append((order, matrix[order, k]))
    posts, holders, before = earlier_partners(prefixes, post) if post is not None else (np.zeros(0, np.int64),) * 2 + ([np.zeros(0, np.int64)] * len(prefixes),)
    probes = np.flatnonzero(asks)
    bounds = [(np.searchsorted(values, matrix[probes, k], "left"), np.searchsorted(values, matrix[probes, k], "right")) for k, (_, values) in enumerate(inverted)]
    out_x, out_y = [], []
    for at, probe in enumerate(probes.tolist()):
        wanted = (colors != colors[probe]) & (5 * np.minimum(sizes, sizes[probe]) >= 4 * np.maximum(sizes, sizes[probe]))
        for lo, hi in zip(np.searchsorted(posts, before[probe], "left").tolist(), np.searchsorted(posts, before[probe], "right").tolist(), strict=True):
            wanted[holders[lo:hi]] = False
        if wanted.any():
            lists = [inverted[k][0][lo[at] : hi[at]] for k, (lo, hi) in enumerate(bounds)]
            found = collisions(matrix[probe], lists, matrix, wanted)
            both = np.array([np.count_nonzero(held) for held in np.split(_within(flat, each, found, sets[probe]), np.cumsum(np.diff(each)[found])[:-1])]) if len(found) else found
            fits = 180 * both >= 80 * (sizes[found] + sizes[probe])
            found, both = found[fits], both[fits]
            if spanning:
                found = found[np.lexsort((classes[found], -both / (sizes[found] + sizes[probe])))]
                found = found[np.unique(colors[found], return_index=True)[1]]
                colors[np.isin(colors, colors[found])] = colors[probe]
            found = classes[found]
            out_x.append(np.minimum(found, classes[probe])), out_y.append(np.maximum(found, classes[probe]))
    if not out_x:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    pairs = np.unique(np.stack([np.concatenate(out_x), np.concatenate(out_y)]), axis=1)
    return pairs[0], pairs[1]


def posts_of(matrix: np.ndarray, rows: np.ndarray, coordinates: np.ndarray) -> np.ndarray:
    """The posts of signatures of a matrix, one for each row number and coordinate."""
    return (coordinates.astype(np.int64) << 32) + (matrix[rows, coordinates].astype(np.int64) & 0xFFFFFFFF)


def _spanning_pairs(group: pa.Table, name: str) -> pa.Table:
    """The spanning pairs of a block whose sets are in the column of this name, each with its block."""
    matrix = group["__sig"].combine_chunks().flatten().to_numpy().reshape(-1, COORDINATES)
    classes, colors, sizes = (group[name].to_numpy() for name in ("__class", "__color", "__size"))
    lists = group["__prefix"].combine_chunks()
    bounds = np.asarray(lists.offsets) - lists.offsets[0].as_py()
    prefixes = np.split(posts_of(matrix, np.repeat(np.arange(len(lists)), np.diff(bounds)), lists.flatten().to_numpy()), bounds[1:-1])
    lists = group[name].combine_chunks()
    sets = np.split(lists.flatten().to_numpy(), np.asarray(lists.offsets)[1:-1] - lists.offsets[0].as_py())
    post = group["__list"][0].as_py()
    post = post if post >= 0 else None  # short lists of one head
    pairs = block_pairs(classes, colors, group["__asks"].to_numpy(), sizes, matrix, prefixes, post, sets, spanning=True)
    shared.release()
    block = [np.full(len(pairs[0]), group[c][0].as_py(), np.int64) for c in BLOCK]
    return pa.table(list(map(pa.array, [*pairs, *block])), names=["__x", "__y", *BLOCK])


def _in_blocks(group: pa.Table) -> pa.Table:
    return _spanning_pairs(group, "__short")


def _in_whole_blocks(group: pa.Table) -> pa.Table:
    return _spanning_pairs(group, "__whole")


def _few(table: DataFrame) -> bool:
    return table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS


def _sets(docs: DataFrame, id: str, text: str, classes: DataFrame, named: DataFrame, name: str = "short") -> DataFrame:
    """(class, set) of the named classes, made anew from one document of each: its hashes, or the lowest 16 bits of them (``short``), sorted."""
    bits, kind, sql = SETS[name]
    wanted = classes.join(named, "__class", "left_semi").select(F.col("__first").alias("__wanted"), "__class", "__a", "__b")
    wanted = shared.kept(wanted, f"wanted-{name}")
    rows = docs.select(F.col(id), F.col(text)).join(F.broadcast(wanted) if _few(wanted) else wanted, F.col(id) == F.col("__wanted"))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in shared.slices(batch, text, _SLICE):
                names, sets = [], []
                for number, a, b, own in zip(*(shared.column(piece, c).to_pylist() for c in ("__class", "__a", "__b")), shingles_of(shared.column(piece, text)), strict=True):
                    if set_key(own) == (a, b):  # an id may stand at several texts
                        names.append(number), sets.append(np.sort(own.astype(bits).view(kind)))
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), _lists(sets, kind)], names=["__class", f"__{name}"])

    made = shared.in_batches(rows.select(text, "__class", "__a", "__b"), make, f"__class long, __{name} array<{sql}>").dropDuplicates(["__class"])
    return shared.kept(made, f"sets-{name}")


def _confirmed(pairs: DataFrame, docs: DataFrame, id: str, text: str, classes: DataFrame, label: str) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    return linked(pairs, docs, id, text, classes, shingles_of, set_key, BROADCAST_ROWS, label)


def _shared_posts(classes: DataFrame) -> DataFrame:
    """(class, size, last, prefix) of every class that shares as many posts as a match takes; posts from rare to frequent, as (held, post)."""
    posted = classes.select("__class", "__size", F.posexplode("__sig").alias("__k", "__value"))
    post = (F.col("__k").cast("long") * (1 << 32) + F.col("__value").cast("long").bitwiseAND(0xFFFFFFFF)).alias("__post")
    posts = shared.kept(posted.select("__class", "__size", post), "posts")
    held = shared.kept(posts.groupBy("__post").agg(F.count(F.lit(1)).alias("__held")).where("__held > 1"), "held")
    frequent = held.where(F.col("__held") > LIST_ROWS)  # no more than posts / LIST_ROWS, and met by broadcast where it has few rows
    usual = posts.join(held.where(F.col("__held") <= LIST_ROWS), "__post")
    hot = posts.join(F.broadcast(frequent) if _few(frequent) else frequent, "__post")
    shares = usual.unionByName(hot).groupBy("__class", "__size").agg(F.sort_array(F.collect_list(F.struct("__held", "__post"))).alias("__posts"))
    # Posts that nobody shares come first in the order, and count for the prefix.
    alone = COORDINATES - F.size("__posts")
    mine = F.slice("__posts", F.lit(1), F.greatest(F.lit(PREFIX) - alone, F.lit(0)))
    few = shares.where(alone <= COORDINATES - LEAST_MATCHES)
    return shared.kept(few.select("__class", "__size", F.element_at("__posts", -1).alias("__last"), mine.alias("__prefix")), "shares")


def _beside_heads(listed: DataFrame, tops: DataFrame, colors: DataFrame | None = None) -> DataFrame:
    """The different pairs (head, member) of the lists; with colors, those of different ones."""
    tops = tops.select("__post", "__x", "__size_x", "__n")
    own = listed.select("__post", "__class", "__size")
    if colors is not None:
        own = own.join(colors.select("__class", F.col("__color").alias("__of")), "__class")
        tops = tops.join(colors.select(F.col("__class").alias("__x"), F.col("__color").alias("__of_x")), "__x")
    frequent = tops.where(F.col("__n") > LIST_ROWS)
    near = own.join(tops.where(F.col("__n") <= LIST_ROWS), "__post").unionByName(own.join(F.broadcast(frequent) if _few(frequent) else frequent, "__post"))
    if colors is not None:
        near = near.where("__of <> __of_x")
    fits = 5 * F.least("__size", "__size_x") >= 4 * F.greatest("__size", "__size_x")
    return near.where((F.col("__x") < F.col("__class")) & fits).select("__x", F.col("__class").alias("__y")).distinct()


def _tops(listed: DataFrame, label: str) -> DataFrame:
    """(post, head, its size, members) of the lists of two or more; the head is the smallest class."""
    tops = listed.groupBy("__post").agg(F.min(F.struct("__class", "__size")).alias("__top"), F.count(F.lit(1)).alias("__n")).where("__n > 1")
    return shared.kept(tops.select("__post", F.col("__top.__class").alias("__x"), F.col("__top.__size").alias("__size_x"), "__n"), label)


def _matches(pairs: DataFrame, classes: DataFrame, label: str) -> DataFrame:
    """The pairs whose signatures agree often enough, by the lowest byte of each minimum; by chance a byte agrees once in 256."""
    pairs = shared.kept(pairs, f"pairs-{label}")
    classes = classes.select("__class", F.transform("__sig", lambda value: (value.bitwiseAND(255) - 128).cast("tinyint")).alias("__sig"))
    agree = F.aggregate(F.zip_with("__sig_x", "__sig_y", lambda a, b: (a == b).cast("int")), F.lit(0), lambda n, same: n + same)
    return shared.kept(both_ends(pairs, classes, classes, {"__sig": "__sig_"}).where(agree >= LEAST_MATCHES).select("__x", "__y"), f"matches-{label}")


def _merged(found: DataFrame, links: DataFrame) -> DataFrame:
    """(class, color) after links between classes of several colors."""
    one, other = found.toDF("__x", "__cx"), found.toDF("__y", "__cy")
    between = links.join(one, "__x").join(other, "__y").select(F.col("__cx").alias("__x"), F.col("__cy").alias("__y")).distinct()
    wider = components(found.select(F.col("__color").alias("__node")).distinct(), between, "__x", "__y")
    return shared.kept(found.toDF("__class", "__node").join(wider, "__node").select("__class", F.col("__component").alias("__color")), "colors")


def _dealt(members: DataFrame) -> DataFrame:
    """(block, class, color, asks) of the members of lists: a block of those that ask meets every block of the list once."""
    asking, blocks = F.ceil(F.col("__outside") / LIST_ROWS).cast("int"), F.ceil(F.col("__members") / LIST_ROWS).cast("int")
    place = F.xxhash64("__class")
    asks = members.where("__color <> __main").select("__list", "__class", "__color", F.pmod(place, asking).alias("__row"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("__col"), F.lit(True).alias("__asks"))
    answers = members.select("__list", "__class", "__color", F.explode(F.sequence(F.lit(0), asking - 1)).alias("__row"), F.pmod(place, blocks).alias("__col"), F.lit(False).alias("__asks"))
    return asks.unionByName(answers).groupBy(*BLOCK, "__class", "__color").agg(F.max("__asks").alias("__asks"))


def _finer(dealt: DataFrame) -> DataFrame:
    """The blocks in parts that hold no more bytes of whole hashes than a block holds of short ones; each pair of a block is met in one of them."""
    parts = F.ceil(F.col("__n") / max(1, LIST_ROWS // 4)).cast("int")
    rows = dealt.join(dealt.groupBy(*BLOCK).agg(F.count(F.lit(1)).alias("__n")), BLOCK)
    place, every = F.pmod(F.xxhash64("__class", F.lit("part")), parts), F.explode(F.sequence(F.lit(0), parts - 1))
    asks = rows.where("__asks").select(*BLOCK, "__class", "__color", "__asks", place.alias("__part_x"), every.alias("__part_y"))
    answers = rows.select(*BLOCK, "__class", "__color", F.lit(False).alias("__asks"), every.alias("__part_x"), place.alias("__part_y"))
    return asks.unionByName(answers).groupBy(*BLOCK, "__part_x", "__part_y", "__class", "__color").agg(F.max("__asks").alias("__asks"))


def _torn(given: DataFrame, colors: DataFrame) -> DataFrame:
    """The blocks that gave a pair which is no link and whose ends no link has joined."""
    x, y = (colors.toDF(side, f"__of{side[2:]}") for side in ("__x", "__y"))
    return shared.kept(given.join(x, "__x").join(y, "__y").where("__ofx <> __ofy").select(*BLOCK).distinct(), "torn")


def similar_classes(docs: DataFrame, id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(id, size, class) of every row with an id, and (class, smallest id of its component) of every class of equal sets."""
    signed = shared.kept(_signed(docs.where(F.col(id).isNotNull()), id, text), "signed")
    keys = signed.where("__size > 0").groupBy("__a", "__b").agg(F.min("__id").alias("__first")).withColumn("__class", F.monotonically_increasing_id())
    keys = shared.kept(keys, "keys")
    heads = signed.where("__size > 0").select("__a", "__b", F.col("__id").alias("__first"), "__size", "__sig")
    # A row may repeat its id and its text: one of them stands for the class.
    classes = shared.kept(heads.join(keys, ["__a", "__b", "__first"]).dropDuplicates(["__class"]), "classes")

    shares = _shared_posts(classes)
    chosen = F.array_distinct(F.array("__last", F.element_at("__prefix", -1), F.element_at("__prefix", F.floor((F.size("__prefix") + 1) / 2).cast("int"))))
    listed = shares.where(F.size("__prefix") > 0).select("__class", "__size", F.explode("__prefix.__post").alias("__post"))
    # Every member against the heads of its most frequent list, and of the last and the middle one of its prefix.
    some = shared.kept(shares.where(F.size("__prefix") > 0).select("__class", "__size", F.explode(chosen).alias("__own")).select("__class", "__size", "__own.__post"), "some")
    links = _confirmed(_matches(_beside_heads(some, _tops(some, "heads-some")), classes, "some"), docs, id, text, classes, "some")
    found = components(classes.select(F.col("__class").alias("__node")), links, "__x", "__y").toDF("__class", "__color")
    # Then against the heads of its whole prefix, where they are not yet together.
    tops = _tops(listed, "heads")
    links = _confirmed(_matches(_beside_heads(listed, tops, found), classes, "near"), docs, id, text, classes, "near")
    colors = _merged(found, links)

    # Lists that still hold several components: members outside of the largest one against all others.
    colored = shared.kept(listed.join(tops.select("__post"), "__post", "left_semi").join(colors, "__class"), "colored")
    mixed_lists = (
        colored.groupBy("__post", "__color").agg(F.count(F.lit(1)).alias("__n"), F.min("__class").alias("__low"))
        .groupBy("__post").agg(F.max(F.struct("__n", "__color")).alias("__most"), F.count(F.lit(1)).alias("__colors"), F.sum("__n").alias("__members"), F.min("__low").alias("__head"))
        .where("__colors > 1").select("__post", F.col("__most.__color").alias("__main"), (F.col("__members") - F.col("__most.__n")).alias("__outside"), "__members", "__head")
    )
    mixed_lists = shared.kept(mixed_lists, "mixed")
    members = colored.join(F.broadcast(mixed_lists) if _few(mixed_lists) else mixed_lists, "__post")
    # Short lists of the same head have much the same members, so these go there once for all of them;
    # a class is the head of no more than PREFIX lists.
    members = members.withColumn("__list", F.when(F.col("__members") <= SHORT_ROWS, -1 - F.col("__head")).otherwise(F.col("__post")))
    short = _sets(docs, id, text, classes, members.select("__class").distinct())
    own = [classes.select("__class", "__size", "__sig"), shares.select("__class", F.transform("__prefix.__post", lambda post: F.shiftright(post, 32).cast("tinyint")).alias("__prefix"))]
    rows = reduce(lambda rows, side: rows.join(side, "__class"), [*own, short], _dealt(members))
    given = shared.kept(rows.groupBy(*BLOCK).applyInArrow(_in_blocks, BLOCK_PAIRS), "given")
    links = _confirmed(shared.kept(given.select("__x", "__y").distinct(), "pairs-across"), docs, id, text, classes, "across")
    colors = _merged(colors, links)
    # Blocks that a pair which is no link held together, once more by whole sets: there every pair is a link.
    torn = _torn(given, colors)
    if not torn.isEmpty():
        again = members.join(torn.select("__list").distinct(), "__list", "left_semi")
        again = _dealt(again).join(torn, BLOCK, "left_semi").drop("__color").join(colors, "__class")
        again = shared.kept(again, "again")
        whole_sets = _sets(docs, id, text, classes, again.select("__class").distinct(), "whole")
        rows = reduce(lambda rows, side: rows.join(side, "__class"), [*own, whole_sets], _finer(again))
        links = rows.groupBy(*BLOCK, "__part_x", "__part_y").applyInArrow(_in_whole_blocks, BLOCK_PAIRS).select("__x", "__y").distinct()
        links = shared.kept(links, "links-torn")
        colors = colors if links.isEmpty() else _merged(colors, links)
    found = colors.toDF("__class", "__component").join(keys.select("__class", "__first"), "__class")
    smallest = found.groupBy("__component").agg(F.min("__first").alias("__smallest"))
    rows = signed.select("__id", "__size", "__a", "__b").join(keys.select("__a", "__b", "__class"), ["__a", "__b"], "left").select("__id", "__size", "__class")
    return rows, found.join(smallest, "__component").select("__class", "__smallest")


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, ``n_shingles``, ``component_id`` and ``kept`` of every row.

    Words are runs of other than white space, A-Z lower-cased; the set of a text are its
    distinct runs of two words, or its one shorter sequence. Texts with equal sets are one
    class; classes link when 100 * intersection >= 80 * union, on full sets.
    ``component_id`` is the smallest id that links reach, ``kept`` says whether it is that
    of the row.

    A text without words, or NULL, has no shingles and is linked with nothing. A row without
    an id belongs to no component (NULL) and is kept. Rows that repeat an id each have the
    component of their own text. An empty table gives none.
    """
    shared.ship(docs.sparkSession)
    rows, found = similar_classes(docs, id, text)
    named = rows.join(found, "__class", "left").select(F.col("__id").alias(id), F.col("__size").alias("n_shingles"), F.coalesce("__smallest", "__id").alias("component_id"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in shared.slices(batch, text, _SLICE):
                yield pa.RecordBatch.from_arrays([pa.array([len(s) for s in shingles_of(shared.column(piece, text))], pa.int64())], names=["n_shingles"])

    none = F.lit(None).cast(dict(docs.dtypes)[id])
    unnamed = shared.in_batches(docs.where(F.col(id).isNull()).select(text), count, "n_shingles long").select(none.alias(id), "n_shingles", none.alias("component_id"))
    every = named.unionByName(unnamed)
    return every.withColumn("kept", F.coalesce(F.col(id) == F.col("component_id"), F.lit(True)))
