"""The prefix trie, the filter audit and exact shards against brute force on small tables full of nulls, ties and repeats."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict
from fractions import Fraction
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from parlance.llm import audit, shards, trie
from test_operators import SCHEMA, corpus, tokens_of

TURNS = "conv_id long, turn long, role string, text string"


# -- 11 ---------------------------------------------------------------------------------------------------------------
def talk(seed=0, n=60):
    """Few texts and roles, so that many prefixes are shared; nulls, ties, repeats, gaps in the ids and one long conversation."""
    rng = random.Random(seed)
    out = []
    for c in [i for i in range(n) if i not in (5, 6, 17)] + [1005, 70_003, 70_004, 140_002]:
        for t in range(rng.choice((1, 2, 3, 9, 14)) if c != 11 else 300):
            out.append((c, rng.choice((t, t, None)), rng.choice(("user", "assistant", None)), rng.choice(("a", "bé", "", None))))
    out += [(3, 0, "user", "a"), (3, 0, "user", "a"), (None, 0, "user", "lost"), (8, 0, "usera", ""), (9, 0, "user", "a")]
    return out


def prefix_nodes(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for *_, r, t in sorted(ts)] for c, ts in own.items()}
    head = {c: zlib.crc32(str(c).encode()) % 9 for c in own}
    path = {c: tuple(own.get(c - c % 5, [])[: head[c]] + ts[head[c] :]) for c, ts in own.items()}
    members = defaultdict(set)
    for c, p in path.items():
        for d in range(len(p) + 1):
            members[p[:d]].add(c)
    kids = Counter(p[:-1] for p in members if p)
    saved, leaves = Counter(), Counter()
    for p, who in members.items():
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(who) - 1) * len(p[-1][1].encode()) if p else 0
            leaves[p[:d]] += p not in kids
    ends = lambda p: hashlib.sha256(",".join(str(c) for c in sorted(members[p]) if path[c] == p).encode()).hexdigest()
    return sorted((min(who), len(p), min(members[p[:-1]]) if p else -1, len(who), kids[p], leaves[p], saved[p], ends(p)) for p, who in members.items())


def found_nodes(df):
    return sorted(tuple(-1 if v is None else v for v in r) for r in trie.nodes(df).collect())


def test_trie_against_brute_force(spark):
    for seed in (0, 1):
        rows = talk(seed)
        df = spark.createDataFrame(rows, TURNS).repartition(3)
        for c in ("depth", "k1", "n", "bytes", "owner", "members", "at", "hash", "head"):
            df = df.withColumn(c, F.lit("x"))
        assert found_nodes(df) == prefix_nodes(rows)


@pytest.mark.parametrize("share", (1, 10**9))
def test_trie_of_one_common_beginning(spark, monkeypatch, share):
    """All prefixes hot, or none: broadcast and shuffled joins agree; ends of one node come in many pieces of ids."""
    monkeypatch.setattr(trie, "HOT_SHARE", share)
    monkeypatch.setattr(trie, "IDS_OF_A_PIECE", 7)
    rows = [(c, t, "user", f"{t if t < 2 else t + c % 3}") for c in range(120) for t in range(3 + c % 2)]
    assert found_nodes(spark.createDataFrame(rows, TURNS)) == prefix_nodes(rows)


def test_trie_of_turnless_and_no_conversations(spark):
    # 5 and 10 exist, 11 has a base with one turn and fewer turns of its own than it skips
    rows = [(10, 0, "user", "x"), (11, 0, "user", "y"), (12, 0, "user", "z"), (3, 0, "u", "q")]
    assert found_nodes(spark.createDataFrame(rows, TURNS)) == prefix_nodes(rows)
    assert trie.nodes(spark.createDataFrame([], TURNS)).count() == 0
    assert trie.nodes(spark.createDataFrame([(None, 0, "user", "x")], TURNS)).count() == 0


# -- 12 ---------------------------------------------------------------------------------------------------------------
def audited(docs, labels):
    """Runs every order filter by filter over the documents."""
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, t in labels if t == 1}
    parts = defaultdict(list)
    for i, text, _, source, _ in docs:
        t, w = text or "", tokens_of(text)
        fails = set()
        fails |= {"A"} if len(w) < 50 else set()
        fails |= {"B"} if 100 * len(set(w)) < 65 * len(w) else set()
        fails |= {"C"} if 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t) else set()
        fails |= {"D"} if set(t) & set("#$%&*|") else set()
        fails |= {"E"} if i is not None and any(j is not None and j < i and (u or "") == t for j, u, *_ in docs) else set()
        parts[source or ""].append((i, fails))
    out = []
    for part, own in parts.items():
        shapley, rows = Counter(), []
        for order in permutations("ABCDE"):
            left = own
            for k, f in enumerate(order):
                lost = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                shapley[f] += len(lost)
                rows.append((part, "".join(order), k + 1, len(left), len(lost), sum(f in x[1] for x in own) - len(lost), sum(x[1] == {f} for x in own), sum(x[0] in good for x in lost), sum(x[0] in toxic for x in lost), f))
        out += [(*r[:-1], shapley[r[-1]]) for r in rows]
    return sorted(out)


LABELS = "doc_id long, quality int, toxic int"


def loud_corpus():
    rng = random.Random(3)
    out = [(i, t, lang, s, n) for i, t, lang, s, n in corpus(4, 60)]
    mixed = " ".join(f"word{i}" for i in range(60))
    out += [(100, mixed, "en", "", 1), (101, mixed, "en", None, 1), (99, mixed, "en", "s1", 1), (99, mixed, "en", "s1", 1), (None, mixed, "en", "s1", 1), (102, mixed.upper(), "en", "s1", 1), (103, mixed + " $", "en", "s2", 1), (104, None, "en", "s2", 1), (105, " A", "en", "s2", 1), (106, "ÀÀÀ a", "en", "only", 1)]
    rng.shuffle(out)
    return out, [(i, rng.choice((0, 1, None)), rng.choice((0, 1, None))) for i in range(0, 107, 2)] + [(99, 1, 0), (99, 0, 1), (None, 1, 1), (5000, 1, 1)]


def test_audit_against_all_orders(spark):
    docs, labels = loud_corpus()
    df = spark.createDataFrame(docs, SCHEMA).repartition(4)
    for c in ("part", "label", "mask", "digest", "is_first", "quality", "toxic"):
        df = df.withColumn(c, F.lit("x"))
    got = sorted(tuple(r) for r in audit.audit(df, spark.createDataFrame(labels, LABELS)).collect())
    assert got == audited(docs, labels)


def test_audit_of_empty_tables(spark):
    docs, labels = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], LABELS)
    assert audit.audit(docs, labels).count() == 0
    one = [(1, "x", "en", "s", 1)]
    assert sorted(tuple(r) for r in audit.audit(spark.createDataFrame(one, SCHEMA), labels).collect()) == audited(one, [])


def test_cells_come_back_from_their_parity_sums(spark):
    rng = random.Random(1)
    masked = [(rng.choice("pq"), rng.randrange(4), rng.randrange(32)) for _ in range(3000)]
    df = audit.parity_sums(spark.createDataFrame(masked, "part string, label int, mask int"))
    got = {(r.part, r.label): r.cells for r in df.select("part", "label", audit.cells(F.col("sums")).alias("cells")).collect()}
    count = Counter(masked)
    assert got == {(p, k): [count[p, k, m] for m in range(32)] for p, k in got} and sum(map(sum, got.values())) == 3000


# -- 13 ---------------------------------------------------------------------------------------------------------------
def quantile(u, total, marked, drawn):
    """The least x whose distribution function exceeds u, in whole numbers."""
    all_ways, so_far = math.comb(total, drawn), 0
    for x in range(max(0, drawn - total + marked), min(drawn, marked) + 1):
        so_far += math.comb(marked, x) * math.comb(total - marked, drawn - x)
        if so_far > Fraction(u) * all_ways:
            return x


def test_hypergeometric_is_the_exact_quantile(spark):
    rng = random.Random(5)
    asked = [(rng.random(), n, m, d) for n, m, d in [(1, 0, 1), (1, 1, 1), (5, 2, 3), (10, 10, 4), (10, 4, 10), (40, 1, 39), (300, 299, 7), (1000, 60, 400), (4000, 250, 1000), (3000, 2990, 1500)] for _ in range(40)]
    df = spark.createDataFrame(asked, "u double, n long, m long, d long")
    got = df.select("u", "n", "m", "d", shards.hypergeometric(F.col("u"), F.col("n"), F.col("m"), F.col("d")).alias("x")).collect()
    assert all(r.x == quantile(r.u, r.n, r.m, r.d) for r in got)


def test_matrices_have_the_probabilities_of_a_uniform_assignment(spark):
    kids = F.array(*[F.struct(F.lit(k).cast("long").alias("k"), F.lit(n).cast("long").alias("n")) for k, n in ((0, 2), (1, 3), (2, 1))])
    room, n = F.array(*[F.lit(x).cast("long") for x in (3, 2, 1)]), 20_000
    rows = spark.range(n).select(F.transform(shards._dealt(F.col("id"), room, kids, 3, 9), lambda x: x["row"]).alias("m"))
    seen = {tuple(map(tuple, r.m)): r["count"] for r in rows.groupBy("m").count().collect()}
    ways = Counter()
    for p in set(permutations((0, 0, 0, 1, 1, 2))):
        ways[tuple(tuple(part.count(k) for k in range(3)) for part in (p[:2], p[2:5], p[5:]))] += 1
    assert set(seen) == set(ways)
    square = sum((seen[m] - n * w / 60) ** 2 / (n * w / 60) for m, w in ways.items())
    assert square < len(ways) + 5 * math.sqrt(2 * len(ways))


def test_matrix_keeps_both_margins_over_many_levels(spark):
    rng = random.Random(2)
    sizes = [(p, rng.randrange(0, 40)) for p in sorted(rng.sample(range(9000), 700))]
    got = {r.part: r.row for r in shards.matrix(spark.createDataFrame(sizes, "part long, n long"), 5, 1).collect()}
    assert {p: sum(r) for p, r in got.items()} == dict(sizes) and all(min(r) >= 0 for r in got.values())
    total = sum(n for _, n in sizes)
    assert [sum(c) for c in zip(*got.values())] == [total // 5 + (k < total % 5) for k in range(5)]


def test_shards_are_exact_and_slots_without_gaps(spark, rows_with_repeats):
    df = spark.createDataFrame(rows_with_repeats, SCHEMA).repartition(7)
    for c in ("_part", "_place", "shard", "slot", "size", "row", "node", "n"):
        df = df.withColumn(c, F.lit("x"))
    for k in (16, 3):
        got = [tuple(r) for r in shards.digest(df, k, 4).collect()]
        assert Counter(r[:4] for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), "rows") for i, t, *_ in rows_with_repeats)
        n, of = len(got), defaultdict(list)
        for *_, shard, slot, grown in got:
            of[shard].append(slot)
            assert grown is None
        assert {s: sorted(x) for s, x in of.items()} == {s: list(range(n // k + (s < n % k))) for s in range(k)}


@pytest.fixture(scope="module")
def rows_with_repeats():
    rows = corpus(7, 90)
    return rows + rows[:20] + [(None, None, None, None, None)] * 3 + [(4, "same", "en", "s", 4)] * 30


def test_shuffle_is_even_and_depends_on_its_seed_alone(spark):
    df = spark.range(0, 6000, 1, 9)
    runs = []
    for seed in (1, 1, 2):
        runs.append({r.id: (r.shard, r.slot) for r in shards.shuffled(df, [F.col("id")], 6, seed, bucket_rows=100).collect()})
    assert runs[0] == runs[1] != runs[2] and sorted(runs[0].values()) == [(s, i) for s in range(6) for i in range(1000)]
    for run in (runs[0], runs[2]):
        for part in range(9):  # where a row lay says nothing of its shard, nor of its half of the shard
            own = [run[i] for i in range(6000) if i * 9 // 6000 == part]
            for s in range(6):
                assert abs(sum(x[0] == s for x in own) - len(own) / 6) < 5 * math.sqrt(len(own) * 5 / 36)
            assert abs(sum(x[1] < 500 for x in own) - len(own) / 2) < 5 * math.sqrt(len(own) / 4)
    assert abs(sum(runs[0][i][0] == runs[2][i][0] for i in range(6000)) - 1000) < 5 * math.sqrt(6000 * 5 / 36)
    assert shards.shuffled(df.where("id < 0"), [F.col("id")]).count() == 0
