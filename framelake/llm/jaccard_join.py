"""N-gram Jaccard self-join by token-combination prefixes, and the groups that its links make.

Tokens are a document's distinct word shingles as 64-bit hashes. Documents of equal sets are one set from here on.

Order and classes. Tokens that `often` sets or more have are *frequent*, all others *rare*, at every size of corpus: how many
sets have a token is asked over all blocks (blocks.py; by 48 bits, as classes decide the cost, not the result). Each set orders its rare
tokens first, then its frequent ones, each class by hash. Two sets with J >= 0.75 share at least a = ceil(0.75 n) tokens, so of the
first n - a + l tokens of each they share at least l. Prefixes are extended to l = 1 + 8 * (2 - 1) = 9.

Links of sets that share a rare token. Rare tokens are indexed alone, and a key has fewer than `often` sets. A linked pair shares 9
tokens of its prefixes, so as many rare ones as 9 is more than the frequent ones in either prefix (one at least); pairs with fewer are out.
The others are verified in full, by 48 bits of each token: their sets meet at the pair's first set, in portions of at most `star_portion` partners.

Links of sets that share no rare token. Only sets whose frequent tokens alone are a or more can have them, all their rare tokens are in the
prefix, and what such a pair shares are frequent tokens. So sets of equal size and equal frequent tokens are one *unit*: all of them link with the same others, and with
each other all or not at all. Pages of one template with few words of their own are one unit, however many they are. Units index
their prefix's frequent tokens, dealt into 8 groups, in combinations of 2 within a group: at most 8 shared tokens, one of each
group, make no common key, so a linked pair has one. Units too small for 9 shared tokens (a < 9) also index a plain prefix of single tokens.
Keys that at most `all_pairs` units have are paired. In keys that more have, the unit of the least number is compared with all others (a star); keys are
rows throughout, so that Spark aggregates hot ones in parts. Where members stay unconnected, keys that share members make up an area;
the members outside the area's largest group are compared with all of the area, in chunks of `queries` by `tokens`, and one link to each other group is
reported. Units connected already need no comparison, since only groups are asked for. Nothing is dropped.

Defined cases: a text without words has the empty set, which links with nothing, not even another; fewer words than a
shingle are one shingle; null texts are empty; null ids never are a group's name unless all are null; repeated rows are
copies of each other; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm.blocks import QUESTION, Blocks, Exchange, answer_table, answered, by_range, dealt, in_order, member, merge, pack, pack_keys, question, read_questions, spread, unpack, unpack_keys
from framelake.llm.common import LOWER, Scratch, attach, materialize, read
from framelake.llm.words import Words, distinct, mix, portions, windows

GROUPS, COMBINED = 8, 2
NEED = 1 + GROUPS * (COMBINED - 1)
INDEX_BITS, PLACE_BITS = 28, 24  # a set's number: block, slack (how many shared rare tokens may lack), place in the block
PLACE, SLACK = (1 << PLACE_BITS) - 1, 15 << PLACE_BITS
CLASS_BITS = ~np.uint64(0xFFFF)  # of a token's hash, for its class


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    out = []
    for begin, end in portions(texts):
        words = Words(texts[begin:end])
        hashes, first = words.hashes(), words.first.tolist()
        codes = windows(hashes, size)
        for i in range(end - begin):
            a, z = first[i], first[i + 1]
            if z - a >= size:
                out.append(distinct(codes[a : z - size + 1]))
            elif z > a:
                out.append(windows(hashes[a:z], z - a) + np.uint64(z - a))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def least_overlap(n, percent: int):
    return -(-percent * n // 100)


def rare_keys(tokens: np.ndarray, often: np.ndarray, percent: int) -> tuple[np.ndarray, int]:
    """(keys of a set's rare tokens in its prefix, how many of the NEED shared ones may lack); often: flags of the tokens."""
    n, a, n_rare = len(tokens), least_overlap(len(tokens), percent), len(tokens) - int(often.sum())
    reach = min(n, n - a + NEED)
    return mix(tokens[~often][: min(reach, n_rare)]), NEED if a < NEED else min(NEED, max(0, reach - n_rare))


def frequent_keys(frequent: np.ndarray, n: int, percent: int) -> np.ndarray:
    """Keys of the frequent tokens in the prefix of a set of n tokens, which are in order."""
    a = least_overlap(n, percent)
    chosen = frequent[: len(frequent) - a + NEED]
    group = (mix(chosen) % np.uint64(GROUPS)).astype(np.int64)
    keys = [np.zeros(0, np.uint64)]
    for g in range(GROUPS):
        own = chosen[group == g]
        if len(own) >= COMBINED:
            first, second = np.triu_indices(len(own), 1)
            keys.append(mix(mix(own[first]) + own[second]) ^ np.uint64(0x5BD1))
    if a < NEED:
        keys.append(mix(frequent[: len(frequent) - a + 1] ^ np.uint64(0x5A11)))
    return np.concatenate(keys)


def short(tokens: np.ndarray) -> bytes:
    """6 bytes of each hash."""
    return tokens.view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _numbers(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return np.sort(out.view(np.uint64).ravel())


def _describe(size: int):
    def describe(table):
        """A row for each document."""
        block, ids, texts = in_order(table)
        if len(ids) > PLACE:
            raise ValueError(f"block {block} holds {len(ids)} documents; give Blocks smaller blocks")
        sets = shingle_sets([t.translate(LOWER) for t in texts], size)
        digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
        refs = [block << INDEX_BITS | i for i in range(len(ids))]
        return pa.table({"ref": pa.array(refs, pa.int64()), "doc_id": pa.array(ids, table.schema.field("doc_id").type), "n": pa.array([len(s) for s in sets], pa.int64()), "digest": pa.array(digests, pa.binary())})

    return describe


def _chosen(table: pa.Table, places: list[int], size: int) -> tuple[int, list[int], list[np.ndarray]]:
    """(block, places in order, their sets)."""
    block, _, texts = in_order(table)
    places = sorted(places)
    return block, places, shingle_sets([texts[i].translate(LOWER) for i in places], size)


def _ask_classes(size: int, fan: int):
    def ask(table, guide):
        block, _, sets = _chosen(table, guide["place"].to_pylist(), size)
        tokens, counts = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]) & CLASS_BITS, return_counts=True)
        return question(block, tokens, counts.astype(np.uint32), fan)

    return ask


def _is_often(least: int):
    def answer(table):
        keys, counts, _ = read_questions(table, np.uint32)
        known, total, _ = merge(keys, counts)
        return answer_table(table, [(total >= least)[np.searchsorted(known, k)] for k in keys])

    return answer


def _classed(table: pa.Table, guide: pa.Table, size: int, fan: int):
    """(block, and for each chosen set its place, its tokens and which of them are frequent)."""
    rows = guide.to_pydict()
    block, places, sets = _chosen(table, [p for p in rows["place"] if p is not None], size)
    tokens = np.concatenate([np.zeros(0, np.uint64), *sets]) & CLASS_BITS
    order = np.argsort(tokens)
    tokens = tokens[order]
    new = np.concatenate([[True], tokens[1:] != tokens[:-1]])[: len(tokens)]
    often = np.zeros(len(tokens), bool)
    often[order] = answered(tokens[new], {p: a for p, a in zip(rows["part"], rows["answers"], strict=True) if p is not None}, fan, bool)[np.cumsum(new) - 1]
    return block, [(i, s, f) for i, s, f in zip(places, sets, np.split(often, np.cumsum([len(s) for s in sets])[:-1]) if sets else [], strict=True)]


_POSTS = "part int, block long, keys binary, refs binary"


def _posts(block: int, keys: np.ndarray, refs: np.ndarray, n_parts: int) -> pa.Table:
    order, used, begin, end = dealt(keys, n_parts)
    keys, refs = keys[order], refs[order]
    pairs = list(zip(begin.tolist(), end.tolist(), strict=True))
    return pa.table([pa.array(used), pa.array(np.full(len(used), block)), *(pa.array([f(x[b:e]) for b, e in pairs], pa.binary()) for x, f in ((keys, pack_keys), (refs, pack)))], ["part", "block", "keys", "refs"])


def _read_posts(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(keys, numbers of sets with their slack)."""
    keys = [unpack_keys(k) for k in table["keys"].to_pylist()]
    refs = [unpack(r, len(k), np.uint32) for k, r in zip(keys, table["refs"].to_pylist(), strict=True)]
    blocks = table["block"].to_pylist()
    return np.concatenate(keys), np.concatenate([r if r.dtype == np.int64 else r.astype(np.int64) | b << INDEX_BITS for r, b in zip(refs, blocks, strict=True)])


def _post_rare(size: int, percent: int, fan: int):
    def post(table, guide):
        """The keys of the block's sets, each with the set's place in the block, by part."""
        block, sets = _classed(table, guide, size, fan)
        keys, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint32)]
        for i, tokens, often in sets:
            own, slack = rare_keys(tokens, often, percent)
            keys.append(own)
            places.append(np.full(len(own), i | slack << PLACE_BITS, np.uint32))
        return _posts(block, *_sorted(np.concatenate(keys), np.concatenate(places)), fan)

    return post


def _sorted(keys: np.ndarray, refs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    return keys[order], refs[order]


def _relay_posts(n_parts: int):
    def relay(table):
        return _posts(table["relay"][0].as_py(), *_sorted(*_read_posts(table)), n_parts)

    return relay


_PAIRS = "pairs int, first binary, second binary, shared binary"


def _pair_up(n_parts: int):
    def pair_up(table):
        """Pairs of sets that share rare tokens, with how many; a key has fewer than `often` sets."""
        key, ref = _read_posts(table)
        order = np.lexsort((ref, key))
        key, ref = key[order], ref[order]
        begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sizes = np.diff(np.append(begin, len(key)))
        names, place = np.unique(ref, return_inverse=True)
        codes = [np.zeros(0, np.int64)]
        for size in np.unique(sizes[sizes > 1]).tolist():
            rows = place[begin[sizes == size][:, None] + np.arange(size)]
            a, b = np.triu_indices(size, 1)
            codes.append((rows[:, a] * len(names) + rows[:, b]).ravel())
        code, shared = np.unique(np.concatenate(codes), return_counts=True)
        first, second = names[code // max(1, len(names))], names[code % max(1, len(names))]
        keep = first != second
        first, second, shared = first[keep], second[keep], shared[keep].astype(np.int32)
        order, used, begins, ends = dealt(mix(first.astype(np.uint64) + mix(second.astype(np.uint64))), n_parts)
        pairs = list(zip(begins.tolist(), ends.tolist(), strict=True))
        return pa.table([pa.array(used), *(pa.array([x[order[b:e]].tobytes() for b, e in pairs], pa.binary()) for x in (first, second, shared))], ["pairs", "first", "second", "shared"])

    return pair_up


def _enough(table: pa.Table) -> pa.Table:
    """Pairs that share enough keys over all parts."""
    first, second = (np.concatenate([np.frombuffer(x, np.int64) for x in table[c].to_pylist()]) for c in ("first", "second"))
    shared = np.concatenate([np.frombuffer(x, np.int32) for x in table["shared"].to_pylist()])
    order = np.lexsort((second, first))
    first, second, shared = first[order], second[order], shared[order]
    begin = np.flatnonzero(np.concatenate([[True], (first[1:] != first[:-1]) | (second[1:] != second[:-1])]))
    total = np.add.reduceat(shared, begin)
    first, second = first[begin], second[begin]
    good = total >= np.maximum(1, NEED - (np.minimum(first & SLACK, second & SLACK) >> PLACE_BITS))
    first, second = first[good] & ~SLACK, second[good] & ~SLACK
    return pa.table({"a": pa.array(np.minimum(first, second)), "b": pa.array(np.maximum(first, second))})


_UNITS = "ref long, n long, f long, digest binary, tokens binary, keys array<long>"


def _post_frequent(size: int, percent: int, fan: int):
    def post(table, guide):
        """The sets that may link by frequent tokens alone: their frequent tokens, a name for these and their size, keys."""
        block, sets = _classed(table, guide, size, fan)
        rows = []
        for i, tokens, often in sets:
            n, f = len(tokens), int(often.sum())
            if f >= least_overlap(n, percent):
                own = tokens[often]
                rows.append((block << INDEX_BITS | i, n, f, hashlib.blake2b(own.tobytes() + n.to_bytes(8), digest_size=16).digest(), short(own), frequent_keys(own, n, percent).view(np.int64)))
        columns = [list(c) for c in zip(*rows, strict=True)] or [[]] * 6
        kinds = [pa.int64()] * 3 + [pa.binary()] * 2 + [pa.list_(pa.int64())]
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["ref", "n", "f", "digest", "tokens", "keys"])

    return post


def _key_pairs(table: pa.Table) -> pa.Table:
    """Distinct pairs of the units that share a key; keys have few units."""
    key, ref = table["key"].to_numpy(), table["ref"].to_numpy()
    order = np.lexsort((ref, key))
    key, ref = key[order], ref[order]
    begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    sizes = np.diff(np.append(begin, len(key)))
    names, place = np.unique(ref, return_inverse=True)
    codes = np.zeros(0, np.int64)
    for size in np.unique(sizes).tolist():
        groups = begin[sizes == size]
        a, b = np.triu_indices(size, 1)
        for at in range(0, len(groups), step := max(1, 2_000_000 // max(1, len(a)))):
            rows = place[groups[at : at + step][:, None] + np.arange(size)]
            codes = np.union1d(codes, (rows[:, a] * len(names) + rows[:, b]).ravel())
    first, second = names[codes // max(1, len(names))], names[codes % max(1, len(names))]
    keep = first != second
    return pa.table({"a": pa.array(first[keep]), "b": pa.array(second[keep])})


def _fetch(size: int):
    def fetch(table, wanted):
        """The sets asked for, at the places where they are compared."""
        places = [r & PLACE for r in wanted["ref"].to_pylist()]
        _, chosen, sets = _chosen(table, sorted(set(places)), size)
        data = dict(zip(chosen, sets, strict=True))
        return pa.table({c: wanted[c] for c in ("a", "portion", "ref")} | {"n": pa.array([len(data[p]) for p in places], pa.int64()), "tokens": pa.array([short(data[p]) for p in places], pa.binary())})

    return fetch


def _compare(percent: int):
    def compare(table):
        a = table["a"][0].as_py()
        rows = {r: (n, t) for r, n, t in zip(table["ref"].to_pylist(), table["n"].to_pylist(), table["tokens"].to_pylist(), strict=True)}
        own, data = rows.pop(a)
        first, linked = _numbers(data), []
        for ref, (n, data) in sorted(rows.items()):
            most = min(len(first), len(data) // 6)
            if (100 + percent) * most >= percent * (own + n) and (100 + percent) * int(member(_numbers(data), first).sum()) >= percent * (own + n):
                linked.append(ref)
        return pa.table({"a": pa.array([a] * len(linked), pa.int64()), "b": pa.array(linked, pa.int64())})

    return compare


def verify(pairs: DataFrame, sets, work: Scratch, percent: int, star_portion: int) -> DataFrame:
    """The pairs (a, b) that are similar; sets: (a, portion, ref) to rows with n and tokens."""
    stars = work.keep(pairs.groupBy("a").agg(F.count("*").alias("k"), F.ceil(F.count("*") / star_portion).cast("int").alias("portions")), "stars")
    numbered = attach(pairs, stars, "a", "k").withColumn("portion", F.pmod(F.xxhash64("b"), F.col("portions")).cast("int"))
    wanted = numbered.select("a", "portion", F.col("b").alias("ref")).union(numbered.select("a", "portion", F.col("a").alias("ref")).distinct())
    return sets(wanted).groupBy("a", "portion").applyInArrow(_compare(percent), "a long, b long")


def components(links: DataFrame, work: Scratch, name: str = "components") -> DataFrame:
    """(ref, label): the least number that links lead to; by minima of neighbours and jumps to the label's label."""
    both = work.keep(links.union(links.select("b", "a")).toDF("ref", "other").distinct(), f"{name}-links")
    degrees = work.keep(both.groupBy("other").agg(F.count("*").alias("k")), f"{name}-degrees")
    labels = work.keep(both.groupBy("ref").agg(F.least(F.min("other"), F.col("ref")).alias("label")), f"{name}-0")
    step = 0
    while True:
        step += 1
        known = degrees.join(labels.select(F.col("ref").alias("other"), "label"), "other")
        near = attach(both, known, "other", "k").groupBy("ref").agg(F.min("label").alias("near"))
        lower = work.keep(labels.join(near, "ref").select("ref", F.least("label", "near").alias("label"), F.col("label").alias("old")), f"{name}-{step}-near")
        jump = lower.select(F.col("ref").alias("label"), F.col("label").alias("further"))
        jumps = lower.groupBy("label").agg(F.count("*").alias("k")).join(jump, "label", "left")
        after = work.keep(attach(lower, jumps, "label", "k").select("ref", F.least("label", "further").alias("label"), "old"), f"{name}-{step}")
        labels = after.select("ref", "label")
        if not after.where("label != old").limit(1).count():
            return labels


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    return rows.join(labels, "ref", "left").withColumn("label", F.coalesce("label", "ref"))


def _compare_chunk(percent: int):
    def compare(table):
        """Queries against the members of a chunk; for each query one link to each other group at most."""
        role, refs, labels, n, data = (table[c].to_pylist() for c in ("query", "ref", "label", "n", "tokens"))
        members = [i for i, q in enumerate(role) if not q]
        tokens = [_numbers(data[i]) for i in members]
        names, ids = np.unique(np.concatenate([np.zeros(0, np.uint64), *tokens]), return_inverse=True)
        begin = np.concatenate([[0], np.cumsum([len(t) for t in tokens])[:-1]]).astype(np.int64)
        ref, label, sizes = (np.array([x[i] for i in members]) for x in (refs, labels, n))
        found = []
        for i in (i for i, q in enumerate(role) if q and members):
            own = _numbers(data[i])
            mark = np.zeros(len(names), np.int64)
            mark[np.searchsorted(names, own[member(own, names)])] = 1
            both = np.add.reduceat(mark[ids], begin)
            near = np.flatnonzero(((100 + percent) * both >= percent * (n[i] + sizes)) & (label != labels[i]))
            found += {int(label[k]): (min(refs[i], int(ref[k])), max(refs[i], int(ref[k]))) for k in near.tolist()}.values()
        a, b = zip(*sorted(set(found)), strict=True) if found else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return compare


def _close(open_rows: DataFrame, units: DataFrame, work: Scratch, percent: int, queries: int, tokens: int) -> DataFrame:
    """Links between groups that the stars left apart: (a, b). open_rows: (key, hub, ref, label)."""
    areas = components(open_rows.where("hub != ref").select(F.col("hub").alias("a"), F.col("ref").alias("b")).distinct(), work, "areas").withColumnRenamed("label", "area")
    members = work.keep(open_rows.select("ref", "label").distinct().join(areas, "ref").join(units.select("ref", "n", "tokens"), "ref"), "members")
    groups = members.groupBy("area", "label").agg(F.count("*").alias("k"), F.sum("n").alias("t")).groupBy("area")
    chunks = groups.agg(F.max_by("label", F.struct("k", "label")).alias("main"), (F.sum("k") - F.max("k")).alias("q"), F.sum("t").alias("t"), F.sum("k").alias("k"))
    chunks = chunks.select("area", "main", F.ceil(F.col("q") / queries).cast("int").alias("nq"), F.ceil(F.col("t") / tokens).cast("int").alias("nm"), "k")
    placed = attach(members, work.keep(chunks, "chunks"), "area", "k")
    place, every = lambda n: F.pmod(F.xxhash64("ref"), F.col(n)).cast("int"), lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    common = ["ref", "label", "n", "tokens", "area"]
    asking = placed.where("label != main").select(*common, place("nq").alias("qc"), every("nm").alias("mc"), F.lit(True).alias("query"))
    asked = placed.select(*common, every("nq").alias("qc"), place("nm").alias("mc"), F.lit(False).alias("query"))
    return asking.union(asked).groupBy("area", "qc", "mc").applyInArrow(_compare_chunk(percent), "a long, b long")


def _rare_links(blocks: Blocks, guide: DataFrame, size: int, percent: int, star_portion: int) -> DataFrame:
    """Links of sets that share a rare token."""
    work, n_parts, fan = blocks.work, blocks.n_parts, min(blocks.n_parts, blocks.fan)
    posts = blocks.run(_post_rare(size, percent, fan), _POSTS, guide)
    if blocks.n_blocks > blocks.fan:  # in two hops, as questions go
        n_relays = math.ceil(blocks.n_blocks / fan) * fan
        relays = spread(posts.withColumn("relay", F.floor(F.col("block") / fan) * fan + F.col("part")), "relay", n_relays)
        posts = relays.groupBy("relay").applyInArrow(_relay_posts(n_parts), _POSTS)
    found = spread(posts, "part", n_parts).groupBy("part").applyInArrow(_pair_up(n_parts), _PAIRS)
    pairs = work.keep(spread(found, "pairs", n_parts).groupBy("pairs").applyInArrow(_enough, "a long, b long"), "rare-pairs")
    fetched = lambda wanted: blocks.run(_fetch(size), "a long, portion int, ref long, n long, tokens binary", wanted.withColumn("block", F.shiftright("ref", INDEX_BITS)))
    return work.keep(verify(pairs, fetched, work, percent, star_portion), "rare-links")


def near_duplicates(docs: DataFrame, *, id_col="doc_id", text_col="text", size: int = 5, percent: int = 75, often: int = 8, all_pairs: int = 64, star_portion: int = 100, queries: int = 250, tokens: int = 400_000, **sizes) -> DataFrame:
    """A row for each document: doc_id, n_shingles, component_id (the least id that links lead to). sizes: of Blocks."""
    with Scratch(docs.sparkSession, "jaccard") as work:
        blocks = Blocks(docs, id_col, text_col, work, **sizes)
        fan = min(blocks.n_parts, blocks.fan)
        sets = work.keep(blocks.run(_describe(size), f"ref long, doc_id {blocks.id_type}, n long, digest binary"), "sets")
        same = work.keep(sets.where("digest is not null").groupBy("digest").agg(F.min("ref").alias("rep"), F.count("*").alias("k")), "same")
        chosen = same.select(F.shiftright("rep", INDEX_BITS).alias("block"), F.col("rep").bitwiseAND(PLACE).cast("int").alias("place"))
        classes = Exchange(blocks.run(_ask_classes(size, fan), QUESTION, chosen), blocks, blocks.n_parts, np.uint32, bool)
        answers = work.keep(classes.back(classes.run(_is_often(often))), "classes")
        guide = answers.withColumn("place", F.lit(None).cast("int")).unionByName(chosen, allowMissingColumns=True)

        links = _rare_links(blocks, guide, size, percent, star_portion)

        frequent = work.keep(blocks.run(_post_frequent(size, percent, fan), _UNITS, guide), "frequent")
        alike = work.keep(frequent.groupBy("digest").agg(F.min("ref").alias("unit"), F.count("*").alias("k"), F.first("n").alias("n"), F.first("f").alias("f")), "units")
        units = work.keep(frequent.join(alike.select(F.col("unit").alias("ref")), "ref"), "unit-sets")
        postings = units.select("ref", F.explode("keys").alias("key"))
        stats = work.keep(postings.groupBy("key").agg(F.count("*").alias("k"), F.min("ref").alias("hub")).where("k > 1"), "keys")
        few = F.col("k") <= all_pairs
        shared = work.keep(attach(postings, stats.withColumn("few", few), "key", "k"), "shared")
        n_groups = max(16, shared.count() // 500_000)
        paired = spread(shared.where("few").withColumn("group", F.pmod(F.xxhash64("key"), F.lit(n_groups))), "group", n_groups).groupBy("group").applyInArrow(_key_pairs, "a long, b long")
        stars = shared.where("not few and hub != ref").select(F.col("hub").alias("a"), F.col("ref").alias("b"))
        pairs = work.keep(paired.union(stars).distinct(), "unit-pairs")
        found = lambda wanted: wanted.join(units.select("ref", "n", "tokens"), "ref").select("a", "portion", "ref", "n", "tokens")
        unit_links = work.keep(verify(pairs, found, work, percent, star_portion), "unit-links")

        def joined(unit_links: DataFrame, name: str) -> DataFrame:
            """Labels by all links; the sets of a unit are linked if the unit has a link, or is similar enough to itself."""
            linked = unit_links.select(F.col("a").alias("unit")).union(unit_links.select("b")).distinct().withColumn("linked", F.lit(True))
            whole = alike.join(linked, "unit", "left").where(F.col("linked") | ((100 + percent) * F.col("f") >= 2 * percent * F.col("n")))
            members = attach(frequent.select("ref", "digest"), work.keep(whole.where("k > 1").select("digest", "unit", "k"), f"{name}-units"), "digest", "k").where("ref != unit")
            return components(links.union(unit_links).union(members.select("unit", "ref")), work, name)

        labels = joined(unit_links, "first")
        hot = shared.where("not few").select("key", "hub", "ref")
        marked = work.keep(_labelled(hot, labels), "hot")
        opened = marked.groupBy("key").agg(F.min("label").alias("least"), F.max("label").alias("most"), F.count("*").alias("k")).where("least != most").select("key", "k")
        waiting = work.keep(attach(marked, work.keep(opened, "open-keys"), "key", "k"), "open")
        if waiting.limit(1).count():
            late = work.keep(_close(waiting, units, work, percent, queries, tokens), "late-links")
            labels = joined(unit_links.union(late), "second")
        named = same.join(labels.select(F.col("ref").alias("rep"), "label"), "rep", "left").select("digest", "k", F.coalesce("label", "rep").alias("label"))
        labelled = work.keep(attach(sets.where("digest is not null"), named, "digest", "k").select("doc_id", "n", "label"), "labelled")
        smallest = labelled.groupBy("label").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("k"))
        grouped = attach(labelled, work.keep(smallest, "smallest"), "label", "k").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
        alone = sets.where("digest is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
        return materialize(grouped.union(alone), "jaccard-result")


def keep_one(docs: DataFrame, *, id_col="doc_id", text_col="text", max_broadcast: int = 4_000_000, **options) -> DataFrame:
    """docs with one document of each group: that of the least id. Rows that share an id stay or go together; null ids stay."""
    groups = near_duplicates(docs, id_col=id_col, text_col=text_col, **options)
    gone = "gone_" + "_".join(docs.columns)  # a name that docs can't have
    extra = materialize(groups.where("doc_id != component_id").select(F.col("doc_id").alias(gone)).distinct(), "extra")
    extra = F.broadcast(extra) if extra.count() <= max_broadcast else extra.hint("merge")
    return docs.join(extra, F.col(f"`{id_col}`") == F.col(f"`{gone}`"), "left_anti")


def op6_jaccard_join(spark, sf_dir):
    return near_duplicates(read(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT r, least(5, len(w)) AS size, md5(array_to_string(list_slice(w, i, i + least(5, len(w)) - 1), ' ')) AS g FROM d, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS t(i) WHERE len(w) > 0),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
p AS (SELECT a.r AS x, b.r AS y, count(*) AS hit FROM s a JOIN s b ON a.size = b.size AND a.g = b.g AND a.r <> b.r GROUP BY a.r, b.r),
e AS (SELECT x, y FROM p JOIN n nx ON x = nx.r JOIN n ny ON y = ny.r WHERE 100 * hit >= 75 * (nx.n + ny.n - hit)),
c(r, root) AS (SELECT r, r FROM d UNION SELECT e.y, c.root FROM c JOIN e ON e.x = c.r)
SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(o.doc_id) AS component_id FROM c JOIN d ON c.r = d.r JOIN d o ON c.root = o.r LEFT JOIN n ON d.r = n.r GROUP BY d.r, d.doc_id
"""
