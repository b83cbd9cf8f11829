"""N-gram Jaccard join over a token-group matrix: groups of similar documents, their token unions, and only qualifying groups opened."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, components, deleted, ids_hint, most_frequent, named_sets, shingle_sets, steps, written

#: Words of a shingle; similarity as a fraction.
SHINGLE, NUM, DEN = 5, 75, 100
#: Tokens counted together before they leave a task, the count from which one is told, and frequent tokens that are ranked at most.
COUNTED, TOLD, RANKED = 3_000_000, 2, 1 << 17
#: Shingle sets that a task remembers, to post the tokens of copies once.
REMEMBERED = 1 << 18
#: Members of a group that are indexed together, members of one component that make blocks of their own, and the ratio of set sizes
#: within a group.
BLOCK, LARGE, SIZE_STEP = 256, 64, 1.15


def linked_length(n: np.ndarray) -> np.ndarray:
    """Tokens of a set of n, rarest first, among which a linked set must show one: n - ceil(0.75 n) + 1."""
    return n - -(-NUM * n // DEN) + (n > 0)


def _owned(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text, digest): the digest tells texts under one id, or under none, apart."""
    return bounded_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("digest"))


def frequent_tokens(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, counts), at most RANKED, that stand in many documents, sorted by token.

    Tasks tell tokens that they see in TOLD documents of COUNTED tokens. Any order of tokens gives right results; this one, which
    puts frequent tokens last, keeps passages that many documents share out of the prefixes that are joined.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def tell() -> pa.RecordBatch:
            token, c = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(token[c >= TOLD].view(np.int64)), pa.array(c[c >= TOLD].astype(np.int64))], ["token", "c"])

        for batch in batches:
            for _, _, data, offsets in steps(batch, "text"):
                for s in shingle_sets(data, offsets, SHINGLE):
                    held.append(s)
                    size += len(s)
                if size >= COUNTED:
                    yield tell()
                    held, size = [], 0
        if held:
            yield tell()

    counts = written(rows.select("text").mapInArrow(run, "token long, c long").groupBy("token").agg(F.sum("c").alias("c")), "jaccard-counts")
    found = most_frequent(counts, "token", RANKED)
    deleted(counts)
    return found


def signatures(rows: DataFrame, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(doc_id, digest, cls, cls2, n, toks, hot): the row, a 128-bit name of its shingle set, its size, and its prefix in the global
    order (rare first); hot has what is frequent in the prefix.

    Frequent tokens come last, by count; all others by hash, which is as good as random. A task that meets a set again leaves
    its prefix out: copies add about one posting list a task, not one each. Sets of one or two link with equal sets only, which
    are their class, and so have no prefix.
    """
    sent = rows.sparkSession.sparkContext.broadcast(pickle.dumps(frequent))  # at most RANKED tokens
    none = np.zeros(0, np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = pickle.loads(sent.value)
        seen: set[bytes] = set()
        for batch in batches:
            for a, b, data, offsets in steps(batch, "text"):
                names, sizes, toks, hot = [], [], [], []
                for s, name in named_sets(data, offsets, SHINGLE):
                    n = len(s)
                    names.append(name)
                    sizes.append(n)
                    keep = int(linked_length(n)) if n > 2 and name not in seen else 0
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen.add(name)
                    often = none
                    if len(known) and keep:
                        at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                        told = known[at] == s
                        if (n - told.sum()) < keep:
                            often = s[told][np.argsort(counts[at[told]], kind="stable")][: keep - (n - told.sum())]
                        s = s[~told]
                    toks.append(s[:keep])
                    hot.append(often)
                lists = []
                for x in (toks, hot):
                    at = np.concatenate([[0], np.cumsum([len(v) for v in x])]).astype(np.int32)
                    lists.append(pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(x).view(np.int64))))
                halves = np.frombuffer(b"".join(names), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[a:b], batch.column("digest")[a:b], pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy()), pa.array(sizes, pa.int64()), *lists], ["doc_id", "digest", "cls", "cls2", "n", "toks", "hot"])

    return rows.mapInArrow(run, "doc_id long, digest long, cls long, cls2 long, n long, toks array<long>, hot array<long>")


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From postings (token, cls) in order: (token, cls, head) for every class of each token that stands in two or more; head is
    the token's first class. Holds one batch and the head of the last token between batches."""
    held = None  # token, head, whether the head has been told, last class
    for batch in batches:
        token, cls = batch.column("token").to_numpy(), batch.column("cls").to_numpy()
        if not len(token):
            continue
        fresh = np.ones(len(token), bool)
        fresh[1:] = (token[1:] != token[:-1]) | (cls[1:] != cls[:-1])
        fresh[0] = held is None or token[0] != held[0] or cls[0] != held[3]
        last = (token[-1], cls[-1])
        token, cls, told = token[fresh], cls[fresh], False
        if held is not None:
            # the held head stands before this batch's rows, told or not
            told = held[2]
            token, cls = np.concatenate([[held[0]], token]), np.concatenate([[held[1]], cls])
        heads = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        sizes = np.diff(np.append(heads, len(token)))
        tell = np.repeat(sizes > 1, sizes)
        tell[0] &= not told
        held = (last[0], cls[heads[-1]], bool(sizes[-1] > 1 or (told and heads[-1] == 0)), last[1])
        rows = np.flatnonzero(tell)
        if len(rows):
            yield pa.RecordBatch.from_arrays([pa.array(token[rows]), pa.array(cls[rows]), pa.array(cls[np.repeat(heads, sizes)[rows]])], ["token", "cls", "head"])


def shingle_classes(sig: DataFrame) -> DataFrame:
    """(cls, cls2, alike, first, digest, copies, n): the second half of a class's name, and whether all its rows have it; the smallest
    id of the class (null if it has none), the digest of one text there, and that text's rows."""
    rows = sig.where("n > 0").groupBy("cls", "cls2", "doc_id", "digest").agg(F.count("*").alias("copies"), F.first("n").alias("n"))
    # null ids come last
    own = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "digest", "copies")).alias("own")
    grouped = rows.groupBy("cls").agg(own, F.first("n").alias("n"), F.min("cls2").alias("cls2"), (F.min("cls2") == F.max("cls2")).alias("alike"))
    return grouped.select("cls", "cls2", "alike", F.col("own.doc_id").alias("first"), "own.digest", "own.copies", "n")


def named_apart(prefixes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(prefixes, classes), both written: sets whose names agree in 64 bits but not in 128 get another class."""
    while True:
        classes = written(shingle_classes(prefixes), "jaccard-classes")
        clash = classes.where("NOT alike").select("cls", F.col("cls2").alias("least"))
        if clash.isEmpty():
            return prefixes, classes
        other = F.when(F.col("cls2") != F.col("least"), F.xxhash64("cls", "cls2")).otherwise(F.col("cls"))
        renamed = prefixes.join(clash, "cls", "left").select(*[other.alias(c) if c == "cls" else F.col(c) for c in prefixes.columns])
        prefixes = written(renamed, "jaccard-prefixes")


def class_texts(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(cls, cls2, text): the text of each wanted class (cls, cls2, first, digest, copies), by id and digest; equal rows count once."""

    def fetched(some: DataFrame) -> DataFrame:
        some = some.withColumnRenamed("digest", "own_digest")
        return rows.join(ids_hint(some), rows["doc_id"].eqNullSafe(some["first"]) & (rows["digest"] == some["own_digest"])).select("cls", "cls2", "text")

    if wanted.where("copies > 1").isEmpty():
        return fetched(wanted)
    return fetched(wanted.where("copies = 1")).unionByName(fetched(wanted.where("copies > 1")).dropDuplicates(["cls", "text"]))


def shared_tokens(sig: DataFrame) -> DataFrame:
    """(token, cls, head) of every prefix token that two or more classes have; head is the least of them.

    Frequent tokens, RANKED at most, find their heads by a map-side aggregation and get them back by broadcast, so that no task
    sees all postings of one of them. All other tokens are dealt by token and streamed.
    """
    rows = sig.where("n > 2")
    postings = rows.select("cls", F.explode("toks").alias("token"))
    met = postings.repartition("token").sortWithinPartitions("token", "cls").mapInArrow(_met, "token long, cls long, head long")
    hot = rows.select(F.explode("hot").alias("token"), "cls")
    heads = hot.groupBy("token").agg(F.min("cls").alias("head"), F.max("cls").alias("most")).where("head <> most").select("token", "head")
    return met.unionByName(hot.join(F.broadcast(heads), "token").distinct().select("token", "cls", "head"))


def _enough(overlap, n1, n2):
    """Column: the overlap reaches 0.75 of the union."""
    return (NUM + DEN) * overlap >= NUM * (n1 + n2)


def _tail(n):
    """Column: tokens of a set of n that are not in its prefix."""
    return F.ceil(NUM * F.col(n) / DEN) - 1


def similar_groups(shared: DataFrame, classes: DataFrame) -> DataFrame:
    """(cls, n, g): every class that shares a token goes to the head with which it shares most, together with classes of its size."""
    stars = shared.where("cls <> head").groupBy("cls", "head").agg(F.count("*").alias("m"))
    best = stars.groupBy("cls").agg(F.max(F.struct("m", "head")).alias("best")).select("cls", F.col("best.head").alias("head"))
    named = shared.select("cls").distinct().join(best, "cls", "left").join(classes.select("cls", "n"), "cls")
    return named.select("cls", "n", F.xxhash64(F.coalesce("head", "cls"), F.floor(F.log("n") / F.log(F.lit(SIZE_STEP)))).alias("g"))


def opened_groups(shared: DataFrame, groups: DataFrame) -> DataFrame:
    """(cls, own, g): groups that a class must be compared with, its own one or one of a greater number.

    The token-group matrix has a row for each token of each group's union (of prefixes), with the members that have it. The
    tokens of a class's prefix that a group has bound the overlap with any member: what they leave open is at most the rest of
    either set behind its prefix. Of two groups only one asks the other, so that a pair meets once.
    """
    grouped = written(shared.select("token", "cls").join(groups, "cls"), "jaccard-grouped")
    matrix = grouped.groupBy("token", "g").agg(F.count("*").alias("members")).withColumnRenamed("g", "g2")
    facts = groups.groupBy("g").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.max(_tail("n")).alias("tail")).withColumnRenamed("g", "g2")
    met = grouped.join(matrix, "token").where("g < g2 OR (g = g2 AND members > 1)").groupBy("cls", "n", "g", "g2").agg(F.count("*").alias("m"))
    sized = (NUM * F.col("least") <= DEN * F.col("n")) & (NUM * F.col("n") <= DEN * F.col("most"))
    reach = F.col("m") + F.greatest(F.col("tail"), _tail("n"))
    smallest = F.greatest(F.col("least"), F.ceil(NUM * F.col("n") / DEN))
    return met.join(facts, "g2").where(sized & _enough(reach, F.col("n"), smallest)).select("cls", F.col("g").alias("own"), F.col("g2").alias("g"))


def _dealt(table: DataFrame, rows: DataFrame, classes: DataFrame, name: str) -> DataFrame:
    """(a, b), written: the links found in a table (k, asks, cls): whoever asks in block k is compared with its members."""
    dealt = written(table, "jaccard-dealt")
    wanted = written(classes.join(dealt.select("cls").distinct(), "cls", "left_semi").select("cls", "cls2", "first", "digest", "copies"), "jaccard-wanted")
    texts = class_texts(rows, wanted).join(ids_hint(dealt), "cls").select("k", "asks", "cls", "cls2", "text")
    links = written(texts.repartition("k").sortWithinPartitions("k", "asks").mapInArrow(_linked, "a long, b long"), name)
    deleted(dealt, wanted)
    return links


def connected(opened: DataFrame, groups: DataFrame, rows: DataFrame, classes: DataFrame) -> DataFrame:
    """(cls, root) of every class with a link: root is the same for whatever links connect, on whole sets.

    First, each group's members are dealt into blocks of about BLOCK, in which all links are found; the least member of a group
    stands for it and also asks every block of the groups that its own one opens. What these links connect has one label.

    Then only pairs under different labels are left. Members are dealt anew, many of one label into blocks of their own, the rest
    into mixed blocks; a class asks a block only if that holds another label than its own. However large a family of near
    copies is, its members meet in one label first, and are not compared with each other again.
    """
    active = opened.select("g").distinct()
    sizes = groups.groupBy("g").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.min("cls").alias("lead"))
    sizes = written(sizes, "jaccard-sizes")
    # few groups have more than a block, so that a large one is not dealt by its number alone
    in_block = F.when(F.col("blocks").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("cls"), F.col("blocks"))).cast("int")
    members = groups.select("g", "cls").join(ids_hint(active), "g", "left_semi").join(ids_hint(sizes.where("blocks > 1").select("g", "blocks")), "g", "left")
    members = written(members.select("g", "cls", in_block.alias("block"), F.coalesce("blocks", F.lit(1)).alias("blocks")), "jaccard-members")
    pairs = opened.select("own", "g").distinct().join(sizes.select(F.col("g").alias("own"), "lead"), "own").join(sizes.select("g", "blocks"), "g").where("own <> g OR blocks > 1")
    leads = pairs.select("g", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("lead").alias("cls")).select(F.xxhash64("g", "block").alias("k"), F.lit(1).alias("asks"), "cls")
    first = _dealt(members.select(F.xxhash64("g", "block").alias("k"), F.lit(0).alias("asks"), "cls").unionByName(leads), rows, classes, "jaccard-first")

    label = written(components(first, "jaccard-labels").select(F.col("node").alias("cls"), F.col("root").alias("label")), "jaccard-label")
    members = members.join(label, "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    kinds = written(members.groupBy("g", "label").agg(F.count("*").alias("c")), "jaccard-kinds")
    large = kinds.where(F.col("c") >= LARGE).select("g", F.lit(True).alias("large"), F.col("label").alias("low"), F.col("label").alias("high"), "c")
    mixed = kinds.where(F.col("c") < LARGE).groupBy("g").agg(F.lit(False).alias("large"), F.min("label").alias("low"), F.max("label").alias("high"), F.sum("c").alias("c"))
    parts = large.unionByName(mixed).select("g", "large", "low", "high", F.ceil(F.col("c") / BLOCK).cast("int").alias("parts"))
    parts = written(parts, "jaccard-parts")
    big = ids_hint(kinds.where(F.col("c") >= LARGE).select("g", "label", F.lit(True).alias("large")))
    placed = written(members.join(big, ["g", "label"], "left").withColumn("large", F.coalesce("large", F.lit(False))), "jaccard-placed")

    # who asks: another group's part under another label; in one's own group, if it had several blocks, the parts of greater labels
    # from a large label, all other ones from the mixed part, of which only the later blocks
    asked = opened.join(label, "cls", "left").withColumn("label", F.coalesce("label", "cls")).select("cls", "own", "g", "label")
    other = asked.where("own <> g").join(parts, "g").where("NOT (low = label AND high = label)").withColumn("from", F.lit(0))
    # groups of several blocks are few, and their parts are sent to their members, of which a group may have very many
    inner_parts = ids_hint(parts.join(ids_hint(sizes.where("blocks > 1").select("g")), "g", "left_semi"))
    inner = placed.where("blocks > 1").select("cls", "g", "label", F.col("large").alias("mine")).join(inner_parts, "g")
    inner = inner.where("(mine AND large AND low > label) OR (NOT mine AND large) OR (NOT mine AND NOT large AND low <> high)")
    inner = inner.withColumn("from", F.when(F.col("large"), 0).otherwise(F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int") + 1)).where(F.col("from") < F.col("parts"))
    to = lambda df: df.select("g", "large", F.when(F.col("large"), F.col("low")).alias("part"), F.explode(F.sequence(F.col("from"), F.col("parts") - 1)).alias("block"), "cls")
    asks = written(to(other).unionByName(to(inner)), "jaccard-asks")
    # the parts that are asked, and mixed parts of groups that had several blocks, as their members meet in new blocks
    needed = asks.select("g", "large", "part").distinct().unionByName(placed.where("blocks > 1 AND NOT large").select("g", "large", F.lit(None).cast("long").alias("part")).distinct()).distinct()
    if needed.isEmpty():
        return label.withColumnRenamed("label", "root")
    on = (F.col("g") == F.col("g_")) & (F.col("large") == F.col("large_")) & F.col("part").eqNullSafe(F.col("part_"))
    of = lambda df: df.select("g", "large", F.when(F.col("large"), F.col("low")).alias("part"), "parts")
    needed = of(parts).join(needed.toDF("g_", "large_", "part_"), on, "left_semi")
    homes = placed.withColumn("part", F.when(F.col("large"), F.col("label"))).join(ids_hint(written(needed, "jaccard-needed")).toDF("g_", "large_", "part_", "parts"), on)
    key = F.xxhash64("g", "large", F.coalesce("part", F.lit(0)), "block")
    homes = homes.withColumn("block", F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int")).select(key.alias("k"), F.lit(0).alias("asks"), "cls")
    second = _dealt(homes.unionByName(asks.select(key.alias("k"), F.lit(1).alias("asks"), "cls")), rows, classes, "jaccard-second")
    # what is left are links between labels
    for c in ("a", "b"):
        second = second.join(label.toDF(c, "l"), c, "left").withColumn(c, F.coalesce("l", c)).drop("l")
    roots = written(components(second, "jaccard-roots"), "jaccard-root")
    named = label.unionByName(roots.join(label.select("cls"), F.col("node") == F.col("cls"), "left_anti").select(F.col("node").alias("cls"), F.col("node").alias("label")))
    return named.join(roots.withColumnRenamed("node", "label"), "label", "left").select("cls", F.coalesce("root", "label").alias("root"))


class _Block:
    """Members' sets as one sorted list of tokens with owners; which members hang together by links."""

    def __init__(self, names: list[int], sets: list[np.ndarray]):
        self.names, self.sizes = names, np.array([len(s) for s in sets])
        tokens, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(tokens, kind="stable")
        self.tokens, self.owner = tokens[order], owner[order]
        self.part = np.arange(len(sets))
        for i, s in enumerate(sets):
            for j in self.linked(s).tolist():
                if self.part[i] != self.part[j]:
                    lo, hi = sorted((self.part[i], self.part[j]))
                    self.part[self.part == hi] = lo

    def linked(self, s: np.ndarray) -> np.ndarray:
        lo, hi = np.searchsorted(self.tokens, s, "left"), np.searchsorted(self.tokens, s, "right")
        counts = hi - lo
        at = np.repeat(lo - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        overlap = np.bincount(self.owner[at], minlength=len(self.names))
        return np.flatnonzero((overlap > 0) & ((NUM + DEN) * overlap >= NUM * (self.sizes + len(s))))

    def own_links(self) -> list[tuple[int, int]]:
        return [(self.names[p], self.names[i]) for i, p in enumerate(self.part.tolist()) if p != i]

    def links(self, name: int, s: np.ndarray) -> list[tuple[int, int]]:
        return [(self.names[p], name) for p in np.unique(self.part[self.linked(s)]).tolist() if self.names[p] != name]


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links from rows (k, asks, cls, cls2, text), members of a block before those that ask. A text whose set has another name than
    its class, as its id and digest are another text's too, is passed over."""
    key, names, sets, block = None, [], [], None
    out: list[tuple[int, int]] = []
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("k", "asks", "cls", "cls2")]
        for a, _, data, offsets in steps(batch, "text"):
            for i, (s, full) in enumerate(named_sets(data, offsets, SHINGLE)):
                k, asks, name, half = (c[a + i] for c in columns)
                if key != k:
                    if sets and block is None:
                        out += _Block(names, sets).own_links()
                    key, names, sets, block = k, [], [], None
                if int.from_bytes(full[8:], "little", signed=True) != half:
                    continue
                if not asks:
                    if name not in names:
                        names.append(name)
                        sets.append(s)
                elif sets:
                    if block is None:
                        block = _Block(names, sets)
                        out += block.own_links()
                    out += block.links(name, s)
        if out:
            yield _pairs(out)
            out = []
    if sets and block is None and (out := _Block(names, sets).own_links()):
        yield _pairs(out)


def _pairs(out: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "b"])


def jaccard_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of docs.

    Words are maximal runs without white space after lower-casing A-Z; a document's set is its distinct 5-word shingles, or the
    whole sequence if it has fewer words. Two documents link when 100 * intersection >= 75 * union; component_id is the smallest
    doc_id that links reach, itself included. Shingles are compared by 64-bit hashes, sets of one or two as wholes by 128 bits.

    Null texts and texts without words have an empty set, link with nothing and form components of their own. Rows with equal
    sets form one class, whatever their ids; a repeated id has one row for each of its rows; a null id never names a component that
    has another id. An empty table gives no rows; other columns are ignored.

    Copies are one class, checked once; classes are told apart by 128 bits, and a text is used for a class only if its set has
    that name. Classes that share prefix tokens are partitioned
    into groups of similar ones; the token-group matrix stores each group's token union and bounds the overlap of a class with
    every group that shares a token with it; only groups that can reach 0.75 are opened, and their members compared on whole
    sets. Any linked pair shares a token of the prefixes, so that none is lost, and nothing is capped. Linked members of a block
    count as connected, so that links stay few where all pairs of a group are linked.
    """
    rows = _owned(docs, id_col, text_col)
    prefixes, classes = named_apart(written(signatures(rows, frequent_tokens(rows)), "jaccard-prefixes"))
    sig = written(prefixes.select("doc_id", "cls", "n"), "jaccard-sets")
    shared = written(shared_tokens(prefixes), "jaccard-shared")
    deleted(prefixes)
    groups = written(similar_groups(shared, classes), "jaccard-groups")
    opened = written(opened_groups(shared, groups), "jaccard-opened")
    roots = written(connected(opened, groups, rows, classes), "jaccard-roots")
    deleted(shared, groups, opened)

    # components by their smallest document; classes without links are on their own
    classes = classes.join(roots, "cls", "left").select("cls", "first", F.coalesce("root", "cls").alias("root"))
    least = classes.groupBy("root").agg(F.min("first").alias("component_id"))
    ids = classes.select("cls", "root").join(least, "root").select("cls", "component_id")
    known = sig.where("n > 0").select("doc_id", "cls", "n").join(ids, "cls").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return known.unionByName(sig.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


#: DuckDB: the same answers, from all pairs of sets that share a shingle.
JACCARD_SQL = r"""
WITH RECURSIVE w AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
     x AS (SELECT rid, len(w) AS words, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM w),
     h AS (SELECT DISTINCT rid, concat_ws(' ', x, lead(x, 1) OVER o, lead(x, 2) OVER o, lead(x, 3) OVER o, lead(x, 4) OVER o) AS token, i > words - 4 AS short, i, words FROM x WINDOW o AS (PARTITION BY rid ORDER BY i)),
     f AS (SELECT DISTINCT rid, token FROM h WHERE i + 4 <= words OR (words < 5 AND i = 1)),
     s AS MATERIALIZED (SELECT rid, md5(string_agg(token, chr(10) ORDER BY token)) AS m, count(*) AS n FROM f GROUP BY rid),
     c AS MATERIALIZED (SELECT m, any_value(n) AS n, min(doc_id) AS first, min(rid) AS rid FROM s JOIN w USING (rid) GROUP BY m),
     t AS MATERIALIZED (SELECT rid, n, hash(token) AS token FROM c JOIN f USING (rid)),
     l AS MATERIALIZED (SELECT a.rid AS a, b.rid AS b FROM t a JOIN t b ON a.token = b.token AND a.rid < b.rid WHERE 100 * a.n >= 75 * b.n AND 100 * b.n >= 75 * a.n
                        GROUP BY a.rid, b.rid, a.n, b.n HAVING 175 * count(*) >= 75 * (a.n + b.n)),
     e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
     r AS (SELECT rid, rid AS reached FROM c UNION SELECT r.rid, e.b FROM r JOIN e ON r.reached = e.a),
     g AS (SELECT c.m, min(d.first) AS component_id FROM r JOIN c USING (rid) JOIN c d ON d.rid = r.reached GROUP BY c.m)
SELECT doc_id, coalesce(n, 0) AS n_shingles, CASE WHEN n IS NULL THEN doc_id ELSE component_id END AS component_id FROM w LEFT JOIN s USING (rid) LEFT JOIN g USING (m)
"""
