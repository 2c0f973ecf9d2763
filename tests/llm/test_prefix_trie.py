import hashlib
import random
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from scriptorium.llm import prefix_trie
from scriptorium.llm.common import heavy_join
from tests.llm.helpers import frame

SCHEMA = "conv_id long, turn long, role string, text string"
FIELDS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def trunc_mod(a, b):
    return a - b * int(a / b)


def brute(rows, family=5, head=9):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            raw = f"{len(role.encode())}:{role}{text}".encode()
            own[conv].append((turn is not None, turn or 0, hashlib.sha256(raw).digest(), (role, text)))
    turns = {c: [t[3] for t in sorted(v)] for c, v in own.items()}
    built = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % head
        built[c] = turns.get(c - trunc_mod(c, family), [])[:h] + turns[c][h:]
    members, ends = defaultdict(list), defaultdict(list)
    for c, seq in built.items():
        ends[tuple(seq)].append(c)
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
    children = Counter(k[:-1] for k in members if k)
    out = []
    for k, convs in members.items():
        below = [n for n in members if n[: len(k)] == k]
        saved = sum((len(members[n]) - 1) * len(n[-1][1].encode()) for n in below if n)
        sha = hashlib.sha256(",".join(map(str, sorted(ends[k]))).encode()).hexdigest() if k in ends else hashlib.sha256(b"").hexdigest()
        parent = min(members[k[:-1]]) if k else None
        out.append((min(convs), len(k), parent, len(convs), children[k], sum(1 for n in below if not children[n]), saved, sha))
    return sorted(out, key=repr)


def result(df):
    assert df.columns == FIELDS
    return sorted((tuple(r) for r in df.collect()), key=repr)


def corpus(seed=2, convs=90):
    rnd = random.Random(seed)
    texts = ["", None, "hi", "HI", "é" * 9, "a long text " * 30]
    rows = []
    for c in [*range(-12, convs), 2**62]:
        if rnd.random() < 0.15:
            continue
        rows += [(c, t if rnd.random() < 0.9 else None, rnd.choice(["user", "assistant", None]) if t else "user", rnd.choice(texts[: 2 + t % 5])) for t in range(rnd.randint(1, 12))]
    return rows + rows[:15] + [(None, 0, "user", "nobody's"), (None, None, None, None)]


def test_nodes_match_brute_force(spark):
    rows = corpus()
    assert result(prefix_trie.prefix_trie(frame(spark, rows, SCHEMA))) == brute(rows)


def test_copies_one_long_conversation_and_turnless_ones(spark):
    rows = [(c, t, "user", f"same {t}") for c in range(0, 600) for t in range(3)]
    rows += [(700, t, "user", f"step {t}") for t in range(2500)]
    # No conversation 800, and turns that the missing head would have replaced.
    rows += [(c, 0, "user", "lost") for c in (801, 802, 803, 804)]
    got = result(prefix_trie.prefix_trie(frame(spark, rows, SCHEMA)))
    assert {r[1] for r in got} == set(range(2501)) and max(r[3] for r in got) == 605
    short = [r for r in rows if r[0] != 700]
    assert result(prefix_trie.prefix_trie(frame(spark, short, SCHEMA))) == brute(short)


def test_pieces_do_not_change_the_list_of_ends(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", 60)
    rows = [(c * 5, 0, "user", "copy") for c in range(400)] + [(7, 0, "user", "other")]
    assert result(prefix_trie.prefix_trie(frame(spark, rows, SCHEMA, parts=5))) == brute(rows)


def test_empty_table(spark):
    assert result(prefix_trie.prefix_trie(frame(spark, corpus(), SCHEMA).where(F.lit(False)))) == []
    assert result(prefix_trie.prefix_trie(frame(spark, [(None, 1, "user", "x")], SCHEMA))) == []


def test_heavy_keys_are_joined_like_others(spark):
    rows = spark.createDataFrame([(i, i % 3 if i < 50 else i) for i in range(80)], "i int, k int")
    facts = rows.groupBy("k").agg(F.count("*").alias("w")).withColumn("v", F.col("k") * 2)
    for least in (1, 5, 1000):
        assert sorted((r["i"], r["v"]) for r in heavy_join(rows, facts, ["k"], "w", least).collect()) == sorted((i, 2 * (i % 3 if i < 50 else i)) for i in range(80))
