"""N-gram Jaccard join with a token-group matrix.

Documents are sets of word shingles.  Equal sets are one *class*.  The join finds every pair of classes whose Jaccard
similarity reaches the threshold, as far as it is needed to know which documents hang together:

1. Tokens (shingle hashes) get one global order: the most common ones, counted exactly over the whole corpus, come
   last, the more so the more common they are; the rest is ordered by hash.  Only the first tokens of each set, its *prefix*, take part in the
   search.  A set of n tokens has a prefix of n - ceil(threshold * n) + shared(n); two sets over the threshold share
   at least as many prefix tokens as ``shared`` says for the smaller one.  Any order gives the same links; a good one gives fewer candidates.
2. In a few turns each class is compared, exactly, with those next to it in the lists of its tokens, and what links is
   one *cluster*, whose members need not be compared with each other any more.
3. Similar clusters, linked or not, are put into a *group*: those whose most widely held token is the same.  The token-group matrix
   has one row for each token and group whose union holds it, whatever the number of clusters and members.
   A class's overlap with a group's union is at most the tokens counted in the matrix plus those after its prefix; only
   groups whose bound reaches the needed overlap are opened, and their members' whole sets compared, block by block.

Thousands of near copies are one cluster, and thousands of texts about a common passage one group, so they never meet as pairs of
rows; links between different clusters are all found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecloom.llm.base import LOWER, discard, flat, list_array, mix, signed, slices, small_batches, span_hashes, word_spans
from vecloom.llm.graph import components, contracted, parents
from vecloom.session import written

WORDS = 5
PERCENT = 80
# Prefix tokens that two linked sets share at least: one for so many tokens of the set, and this at least.  Fewer make
# shorter prefixes, more leave fewer candidates.
SHARED_OF = 20
SHARED = 3
# Tokens seen so often are common, and so many of the commonest are sent around (9 bytes each).  They only order tokens, so
# neither changes a result.
COMMON = 8
COMMON_TOKENS = 1 << 20
# Tokens are counted by 40 bits of their hash, in parts of about so many.
COUNT_BITS = 40
PART_TOKENS = 1 << 22
PARTS = (1 << 8, 1 << 16)
# Groups are met by their rows under so many salts, so that a large group is not one task's work.
SALTS = 8
# Texts that are needed again are first thinned out by this many hash values, at most so many are broadcast.
SIEVE = 1 << 18
# Tokens in a block of an opened group.
BLOCK_TOKENS = 1 << 13
# Turns of grouping before the matrix is searched; they only save work.
ROUNDS = 6
# Classes of which a task remembers that it has sent their prefix.
REMEMBERED = 200_000

_STEP = np.uint64(0xD6E8FEB86659FD93)


def _shingles(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of all texts, and where each text's begin."""
    raw, offsets = flat(texts)
    data = LOWER[raw]
    starts, ends, first = word_spans(data, offsets)
    hashes = span_hashes(data, starts, ends)
    counts = np.diff(first)
    n = np.where(counts >= words, counts - words + 1, (counts > 0).astype(np.int64))
    at = np.concatenate([[0], np.cumsum(n)])
    out = np.zeros(at[-1], np.uint64)
    if len(hashes) >= words:
        rolled = np.zeros(len(hashes) - words + 1, np.uint64)
        for k in range(words):
            rolled = rolled * _STEP + hashes[k : k + len(rolled)]
        rolled = mix(rolled)
        long = np.repeat(counts >= words, n)
        index = np.arange(at[-1]) - np.repeat(at[:-1], n) + np.repeat(first[:-1], n)
        out[long] = rolled[index[long]]
    for row in np.flatnonzero((counts > 0) & (counts < words)):
        value = np.uint64(counts[row])
        for h in hashes[first[row] : first[row + 1]]:
            value = value * _STEP + h
        out[at[row]] = mix(np.array([value]))[0]
    return out, at


class Commonness:
    """Levels of the common tokens: 0 for all others, more for each doubling of their count."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        order = np.argsort(keys)
        self.keys = keys[order].astype(np.uint64)
        self.levels = np.clip(np.log2(np.maximum(counts[order], 1)).astype(np.int64) - 2, 1, 62).astype(np.uint8)
        # Most tokens are told apart from common ones by a few bits.
        self.mask = np.uint64((1 << 22) - 1)
        self.seen = np.zeros(1 << 22, bool)
        self.seen[(self.keys & self.mask).astype(np.int64)] = True

    def of(self, hashes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(hashes), np.uint8)
        if not len(self.keys):
            return out
        key = hashes >> np.uint64(64 - COUNT_BITS)
        some = np.flatnonzero(self.seen[(key & self.mask).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.keys, key[some]), len(self.keys) - 1)
        hit = self.keys[at] == key[some]
        out[some[hit]] = self.levels[at[hit]]
        return out


def _ordered(hashes: np.ndarray, common: Commonness | None) -> np.ndarray:
    """Token ids, sorted as numbers in the global order: level, then hash."""
    tokens = hashes >> np.uint64(6)
    if common is not None:
        tokens |= common.of(hashes).astype(np.uint64) << np.uint64(58)
    return tokens


def _prefix_length(n: int, percent: int) -> int:
    return min(n, n - -(-percent * n // 100) + max(SHARED, n // SHARED_OF))


def _token_parts(batches: Iterator[pa.RecordBatch], words: int, parts: int) -> Iterator[pa.RecordBatch]:
    """All tokens of a task's texts, packed: of each token the bits that its part does not tell."""
    bits = parts.bit_length() - 1
    waiting, held = [], 0

    def packed() -> pa.RecordBatch:
        keys = np.sort(np.concatenate(waiting) >> np.uint64(64 - COUNT_BITS))
        part = (keys >> np.uint64(COUNT_BITS - bits)).astype(np.int64)
        rest = (keys & np.uint64((1 << (COUNT_BITS - bits)) - 1)).astype(np.uint32)
        cuts = np.flatnonzero(np.diff(part, prepend=-1))
        blobs = [rest[start:end].tobytes() for start, end in zip(cuts, [*cuts[1:], len(rest)])]
        return pa.RecordBatch.from_arrays([pa.array(part[cuts], pa.int32()), pa.array(blobs, pa.binary())], ["part", "tokens"])

    with np.errstate(over="ignore"):
        for batch in batches:
            for piece in slices(batch):
                hashes, _ = _shingles(piece.column("text"), words)
                waiting.append(hashes)
                held += len(hashes)
                if held >= PART_TOKENS:
                    yield packed()
                    waiting, held = [], 0
    if held:
        yield packed()


def _common_of_part(table: pa.Table, parts: int) -> pa.Table:
    tokens = np.concatenate([np.frombuffer(blob.as_buffer(), np.uint32) for blob in table.column("tokens")])
    found, counts = np.unique(tokens, return_counts=True)
    often = counts >= COMMON
    keys = found[often].astype(np.int64) | (table.column("part")[0].as_py() << (COUNT_BITS - parts.bit_length() + 1))
    return pa.table({"token": pa.array(keys, pa.int64()), "n": pa.array(counts[often].astype(np.int64), pa.int64())})


def common_tokens(docs: DataFrame, words: int = WORDS) -> Commonness:
    """The commonest tokens of all texts.  Counts are exact up to equal 40-bit hashes; at most ``COMMON_TOKENS`` reach the driver."""
    letters = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    # A word has some six bytes.  A power of two, so that a part is the first bits of its tokens.
    parts = min(max(PARTS[0], 1 << (letters // 6 // PART_TOKENS).bit_length()), PARTS[1])
    packed = docs.select("text").mapInArrow(lambda batches: _token_parts(batches, words, parts), "part int, tokens binary")
    counts = packed.groupBy("part").applyInArrow(lambda table: _common_of_part(table, parts), "token long, n long")
    counts = written(counts, "jaccard-common")
    # Quarters of a doubling, commonest first: as many as there is room for.
    size = F.floor(4 * F.log2("n"))
    least, room = 1 << 30, COMMON_TOKENS
    for row in counts.groupBy(size.alias("size")).agg(F.count("*").alias("n")).orderBy(F.col("size").desc()).collect():
        room -= row["n"]
        if room < 0:
            break
        least = row["size"]
    found = counts.where(size >= least).toArrow()
    discard(counts)
    return Commonness(found.column("token").to_numpy().astype(np.uint64), found.column("n").to_numpy())


def _sets(batches: Iterator[pa.RecordBatch], words: int, percent: int, common: Commonness) -> Iterator[pa.RecordBatch]:
    sent: set[int] = set()
    with np.errstate(over="ignore"):
        for batch in batches:
            for piece in slices(batch):
                hashes, at = _shingles(piece.column("text"), words)
                tokens = _ordered(hashes, common)
                n, a, b = np.zeros(len(piece), np.int64), np.zeros(len(piece), np.uint64), np.zeros(len(piece), np.uint64)
                prefixes, ends = [], [0]
                for row in range(len(piece)):
                    own = np.unique(tokens[at[row] : at[row + 1]])
                    n[row] = len(own)
                    length = 0
                    if len(own):
                        a[row] = np.bitwise_xor.reduce(mix(own)) + np.uint64(len(own))
                        b[row] = np.add.reduce(mix(own ^ _STEP))
                        if int(a[row]) not in sent:
                            length = _prefix_length(len(own), percent)
                            prefixes.append(own[:length])
                            if len(sent) < REMEMBERED:
                                sent.add(int(a[row]))
                    ends.append(ends[-1] + length)
                values = np.concatenate(prefixes) if prefixes else np.zeros(0, np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column("doc_id"),
                        piece.column("text_key"),
                        pa.array(n),
                        pa.array(signed(mix(a))),
                        pa.array(signed(b)),
                        list_array(signed(values), np.array(ends), pa.int64()),
                    ],
                    ["doc_id", "text_key", "n_shingles", "class", "check", "prefix"],
                )


def _whole_sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    with np.errstate(over="ignore"):
        for batch in batches:
            for piece in slices(batch):
                hashes, at = _shingles(piece.column("text"), words)
                tokens = _ordered(hashes, None)
                sets = [np.unique(tokens[at[row] : at[row + 1]]) for row in range(len(piece))]
                ends = np.cumsum([0, *map(len, sets)])
                values = list_array(signed(np.concatenate(sets)), ends, pa.int64())
                yield pa.RecordBatch.from_arrays([piece.column("class"), values], ["class", "tokens"])


def _enough(both: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    return (both > 0) & (100 * both >= percent * (n + m - both))


def _linked_pairs(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = np.zeros(len(batch), bool)
        one, two = batch.column("tokens_a"), batch.column("tokens_b")
        for row in range(len(batch)):
            a, b = one[row].values.to_numpy(), two[row].values.to_numpy()
            keep[row] = _enough(len(np.intersect1d(a, b, assume_unique=True)), len(a), len(b), percent)
        yield batch.select(["a", "b"]).filter(pa.array(keep))


def _linked_blocks(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """For two blocks of classes: a link between each class of the first and each larger cluster of the second that holds one."""

    def opened(block: pa.StructScalar):
        rows = block.values
        sets = rows.field("tokens")
        ends = sets.offsets.to_numpy() - sets.offsets[0].as_py()
        fields = [rows.field(name).to_numpy() for name in ("class", "size", "cluster")]
        return sets.flatten().to_numpy(), ends, *fields

    for batch in batches:
        found: tuple[list, list] = ([], [])
        for row in range(len(batch)):
            asked, a_ends, a_class, a_size, a_cluster = opened(batch.column("asked")[row])
            held, h_ends, h_class, h_size, h_cluster = opened(batch.column("block")[row])
            for q in range(len(a_class)):
                larger = (h_size > a_size[q]) | ((h_size == a_size[q]) & (h_cluster > a_cluster[q]))
                if not larger.any():
                    continue
                own = asked[a_ends[q] : a_ends[q + 1]]
                at = np.minimum(np.searchsorted(own, held), len(own) - 1)
                hits = np.concatenate([[0], np.cumsum(own[at] == held)])
                links = np.flatnonzero(larger & _enough(hits[h_ends[1:]] - hits[h_ends[:-1]], np.diff(h_ends), len(own), percent))
                _, first = np.unique(h_cluster[links], return_index=True)
                found[0].extend(h_class[links[first]].tolist())
                found[1].extend([int(a_class[q])] * len(first))
        yield pa.RecordBatch.from_arrays([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64())], ["a", "b"])


def _active_sets(docs: DataFrame, need: DataFrame, words: int) -> DataFrame:
    """The whole token sets of the classes in ``need`` (class, text_key).

    Only their texts are moved: a sieve of at most ``SIEVE`` hash values is broadcast first, whatever the input.
    """
    cell = F.pmod("text_key", F.lit(SIEVE)).cast("int")
    texts = (
        docs.select(F.xxhash64("text").alias("text_key"), "text")
        .withColumn("_cell", cell)
        .join(F.broadcast(need.select(cell.alias("_cell")).distinct()), "_cell", "left_semi")
        .dropDuplicates(["text_key"])
        .join(need, "text_key")
        .select("class", "text")
    )
    return written(texts.mapInArrow(lambda it: _whole_sets(it, words), "class long, tokens array<long>"), "jaccard-active")


def _fit(n: str, m: str, percent: int):
    """Sets of these sizes can reach the threshold."""
    return (F.col(n) * 100 >= F.col(m) * percent) & (F.col(m) * 100 >= F.col(n) * percent)


def _needed(n: str, percent: int):
    """Prefix tokens that a set shares with any set it links to; that one has ceil(percent of n) tokens at least."""
    least = F.ceil(F.col(n) * percent / 100)
    return F.least(F.greatest(F.lit(SHARED), F.floor(least / SHARED_OF)), least)


def _in_groups(cells: DataFrame, groups: DataFrame | None) -> DataFrame:
    """The cells with their group; a class that is in none is its own."""
    if groups is None:
        return cells.withColumn("grp", F.col("class"))
    named = cells.join(groups.select(F.col("node").alias("class"), "root"), "class", "left")
    return named.withColumn("grp", F.coalesce("root", "class")).drop("root")


def _across(cells: DataFrame, groups: DataFrame | None) -> DataFrame:
    """The cells with their group, of tokens that several groups hold; others say nothing about another group."""
    by_token = Window.partitionBy("token")
    ends = _in_groups(cells, groups).withColumn("_low", F.min("grp").over(by_token)).withColumn("_high", F.max("grp").over(by_token))
    return ends.where("_low <> _high").drop("_low", "_high")


def _neighbours(cells: DataFrame, active: DataFrame, turn: int, percent: int) -> DataFrame:
    """Links among classes that follow each other in a token's list, in an order drawn anew each turn: a few a class."""
    order = Window.partitionBy("token").orderBy(F.xxhash64("class", F.lit(turn)), "class")
    next_one = F.lead(F.struct(F.col("class").alias("b"), F.col("n").alias("n_b"), F.col("grp").alias("grp_b"))).over(order)
    pairs = (
        cells.select(F.col("class").alias("a"), "n", "grp", next_one.alias("next"))
        .select("a", "n", "grp", "next.*")
        .where("grp <> grp_b")
        .groupBy("a", "b", "n", "n_b")
        .agg(F.count("*").alias("hits"))
        .where((F.col("hits") >= _needed("n", percent)) & _fit("n", "n_b", percent))
        .select("a", "b")
    )
    first = active.select(F.col("class").alias("a"), F.col("tokens").alias("tokens_a"))
    second = active.select(F.col("class").alias("b"), F.col("tokens").alias("tokens_b"))
    return pairs.join(first, "a").join(second, "b").mapInArrow(lambda it: _linked_pairs(it, percent), "a long, b long")


def _of_each(rows: DataFrame, table: DataFrame, key: str, by: str) -> DataFrame:
    """``rows`` with the one row of ``table`` that their ``key`` names.  The small rows of the table are there once for each salt, so
    that the many rows of a large group are dealt over as many tasks.  The table grows with the input and is never broadcast."""
    salted = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).hint("merge")
    return rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).join(salted, [key, "_salt"]).drop("_salt")


def _homes(cells: DataFrame) -> DataFrame:
    """Which group a cluster is put into: ``cluster, home``, its token that most clusters hold (ties: the larger)."""
    held = cells.select("token", "cluster").distinct()
    wide = held.groupBy("token").agg(F.count("*").alias("holders"))
    return held.join(wide, "token").groupBy("cluster").agg(F.max_by("token", F.struct("holders", "token")).alias("home"))


def _parts(rows: DataFrame) -> DataFrame:
    """Into how many blocks of about ``BLOCK_TOKENS`` the classes of each ``home`` go: ``home, parts``."""
    return written(rows.groupBy("home").agg(F.ceil(F.sum("n") / BLOCK_TOKENS).cast("int").alias("parts")), "jaccard-parts")


def _blocks(rows: DataFrame, parts: DataFrame, active: DataFrame, name: str) -> DataFrame:
    """Classes with their tokens, gathered by ``home`` in blocks: ``home, part, name``.  They are dealt first, so that few shuffles move tokens."""
    dealt = _of_each(rows, parts, "home", "class").withColumn("part", F.pmod(F.xxhash64("class"), "parts").cast("int"))
    return dealt.join(active, "class").groupBy("home", "part").agg(F.collect_list(F.struct("class", "size", "cluster", "tokens")).alias(name))


def _open_groups(cells: DataFrame, need: DataFrame, clusters: DataFrame, active: DataFrame, percent: int) -> DataFrame:
    """A link between each class and each other cluster that holds one: the search over the token-group matrix.

    Of two clusters the classes of the smaller one ask.  Those that ask for a group and its members both come in blocks of about
    ``BLOCK_TOKENS`` tokens, so that blocks meet blocks, not classes classes.
    """
    members = need.select("class", "n").join(clusters.select(F.col("node").alias("class"), "root"), "class", "left")
    members = written(members.select("class", "n", F.coalesce("root", "class").alias("cluster")), "jaccard-members")
    cells = cells.withColumnRenamed("grp", "cluster")
    sizes = members.groupBy("cluster").agg(F.count("*").alias("size"), F.min("n").alias("n_min"), F.max("n").alias("n_max"))
    sizes = written(_homes(cells).join(sizes, "cluster"), "jaccard-sizes")
    rank = F.struct("size", "cluster")
    groups = sizes.groupBy("home").agg(F.min("n_min").alias("n_min"), F.max("n_max").alias("n_max"), F.max(rank).alias("highest"))
    groups = written(groups, "jaccard-groups")
    placed = _of_each(cells, sizes.select("cluster", "home", "size"), "cluster", "token")
    matrix = placed.select("token", "home").distinct()
    # A class that asks is not met under its own group's tokens only: its group may hold other clusters.
    queries = placed.select("class", "n", rank.alias("rank"), "token")
    opened = (
        queries.join(matrix, "token")
        .groupBy("class", "n", "rank", "home")
        .agg(F.count("*").alias("hits"))
        .where(F.col("hits") >= _needed("n", percent))
    )
    opened = (
        _of_each(opened, groups, "home", "class")
        .where((F.col("highest") > F.col("rank")) & (F.col("n_max") * 100 >= F.col("n") * percent) & (F.col("n") * 100 >= F.col("n_min") * percent))
        .select("class", "n", "home", "rank.size", "rank.cluster")
    )
    opened = written(opened, "jaccard-opened")
    wanted = opened.select("home").distinct()
    held = _of_each(members, sizes.select("cluster", "home", "size").join(wanted, "home", "left_semi"), "cluster", "class")
    parts, parts_asked = _parts(held), _parts(opened)
    blocks = written(_blocks(held, parts, active, "block"), "jaccard-blocks")
    lasts = blocks.groupBy("home").agg(F.max("part").alias("last"))
    asked = _blocks(opened, parts_asked, active, "asked").select("home", "asked").join(lasts, "home")
    # Every block that asks goes to every block of the group: dealt by both, so that a large group is many tasks.
    asked = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("last"))))
    pairs = asked.join(blocks, ["home", "part"]).select("asked", "block")
    found = written(pairs.mapInArrow(lambda it: _linked_blocks(it, percent), "a long, b long"), "jaccard-found")
    discard(members, sizes, groups, opened, parts, parts_asked, blocks)
    return found


def jaccard_join(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``docs`` (doc_id, text, ...) -> (doc_id, n_shingles, component_id, text_key, root), one row for each row of ``docs``.

    ``text_key`` is xxhash64 of the text and ``root`` names the component (null where a text has no shingles).

    ``component_id`` is the smallest doc_id that links reach.  A null, empty or blank text has no shingles and is alone;
    so is its component.  A null doc_id counts as larger than any other: it is a component's id only where all its
    documents have none.  Equal rows stay apart and share a component.  Other columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    common = spark.sparkContext.broadcast(common_tokens(docs, words))
    sets = written(
        docs.select("doc_id", "text", F.xxhash64("text").alias("text_key")).mapInArrow(
            lambda it: _sets(it, words, percent, common.value),
            "doc_id long, text_key long, n_shingles long, class long, check long, prefix array<long>",
        ),
        "jaccard-sets",
    )
    by_token = Window.partitionBy("token")
    tokens = sets.where("n_shingles > 0").select("class", F.col("n_shingles").alias("n"), F.explode("prefix").alias("token"))
    shared = written(
        tokens.withColumn("_low", F.min("class").over(by_token)).withColumn("_high", F.max("class").over(by_token)).where("_low <> _high").drop("_low", "_high"),
        "jaccard-tokens",
    )
    # Nothing reads the prefixes any more, which are nearly all of the table.
    texts = written(sets.drop("prefix"), "jaccard-texts")
    discard(sets)
    classes = written(
        texts.where("n_shingles > 0")
        .groupBy("class", "check", "n_shingles")
        .agg(F.min("text_key").alias("text_key"), F.min("doc_id").alias("least")),
        "jaccard-classes",
    )

    # A class has no more shared tokens than its prefix is long, however many copies or tasks it comes from.
    count = classes.select("class", F.col("n_shingles").alias("n"), "text_key")
    held = shared.groupBy("class").agg(F.collect_set("token").alias("held")).join(count, "class")
    held = written(held.where(F.size("held") >= _needed("n", percent)), "jaccard-need")
    discard(shared)
    need = held.select("class", "n", "text_key")
    cells = held.select("class", "n", F.explode("held").alias("token"))
    active = _active_sets(docs, need.select("class", "text_key"), words)

    links, groups, before = None, None, 0
    for turn in range(ROUNDS):
        found = written(_neighbours(_in_groups(cells, groups), active, turn, percent), "jaccard-links")
        now, last = found.count(), links
        links = contracted(found if last is None else last.unionByName(found), "jaccard-links")
        groups = parents(links)
        discard(found, *([] if last is None else [last]))
        if now * 5 <= before or not now:
            break
        before = max(before, now)
    across = written(_across(cells, groups), "jaccard-cells")
    opened = _open_groups(across, need, groups, active, percent)
    discard(active, across, held)
    roots = components(links.unionByName(opened))
    discard(links, opened)

    rooted = classes.join(roots.select(F.col("node").alias("class"), "root"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("class", "check", "root", "component_id")
    found = texts.join(named, ["class", "check"], "left")
    alone = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return found.select("doc_id", "n_shingles", alone.alias("component_id"), "text_key", "root")


def one_of_each(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``docs`` without near duplicates: of each component the row with the smallest doc_id (ties: smallest text key).

    Repeated rows leave one.  Rows whose text is null or blank link with nothing and all stay.  Columns stay as they are, whatever
    their names.
    """
    joined = jaccard_join(docs, words, percent).where("n_shingles > 0")
    # A struct orders nulls first; a row without an id stands for its component only if no row has one.
    rank = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("text_key").alias("key"))
    kept = joined.groupBy("root").agg(F.min(rank).alias("rank")).select("rank.*")
    blank = F.coalesce(F.col("text"), F.lit("")).rlike(r"^[\x20\x09-\x0D]*$")
    # The row as a whole is one column, so no name of it can clash.
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col("doc_id").isNull().alias("none"),
        F.coalesce("doc_id", F.lit(0)).alias("id"),
        F.xxhash64("text").alias("key"),
        blank.alias("blank"),
    )
    # Repeated rows go before the join and by the same columns, none of which is null: so one shuffle of the texts does for both.
    by = ["none", "id", "key"]
    stay = rows.where(~F.col("blank")).dropDuplicates(by).join(kept, by, "left_semi")
    return stay.select("row").unionByName(rows.where("blank").select("row")).select("row.*")
