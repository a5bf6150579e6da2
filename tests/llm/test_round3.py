"""Language ID, hard negatives and conversation repair against brute force; bounded caches; repeated ids in near-dedup."""

import collections
import hashlib
import itertools
import math
import random
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import byte_bpe, conversation, hard_negative, language_id, line_dedup, near_dup, tokens

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")

# ---- language ID -------------------------------------------------------------------------------


def brute_grams(text):
    """n-grams of one to three letters of the lower-case text, by strings."""
    letters = language_id._letters()
    said = "".join(c if letters[ord(c)] else " " for c in text.lower())
    said = " " + " ".join(said.split()) + " "
    if said == "  ":
        said = " "
    return collections.Counter(said[i : i + n] for n in (1, 2, 3) for i in range(len(said) - n + 1))


def bucket_of(gram):
    h = 0
    for n, c in enumerate(gram, 1):
        h = (h * 0x9E3779B1 + ord(c) * 0x85EBCA6B + n) & 0xFFFFFFFF
    h ^= h >> 15
    h = (h * 0x2C1B3C6D) & 0xFFFFFFFF
    h ^= h >> 13
    return h & (language_id.BUCKETS - 1)


def test_grams_by_brute_force():
    texts = ["Hello, world", "", "123 !", "Ärger im  Büro\n\tnächste", "日本語のテキスト", "a", "İstanbul"] + ["".join(random.Random(i).choice("abc dé.") for _ in range(300)) for i in range(5)]
    for cut in (1, 7, 50, 10_000):
        got = [collections.Counter() for _ in texts]
        for bucket, own in language_id.grams(texts, slice_chars=cut):
            for b, o in zip(bucket.tolist(), own.tolist(), strict=True):
                got[o][b] += 1
        for text, seen in zip(texts, got, strict=True):
            want = collections.Counter()
            for gram, n in brute_grams(text).items():
                want[bucket_of(gram)] += n
            assert seen == want, (cut, text)


LANG_ROWS = [(i, random.Random(i).choice(["der hund und die katze", "das ist ein haus"]) + f" {i}", "de") for i in range(0, 60, 2)]
LANG_ROWS += [(i, random.Random(i).choice(["the dog and the cat", "this is a house"]) + f" {i}", "en") for i in range(1, 60, 2)]


def test_naive_bayes_by_brute_force(spark):
    docs = spark.createDataFrame(LANG_ROWS + [(7, None, "en"), (None, "the dog", "en"), (100, "12 34 !?", "de"), (101, "the house and the dog", None)], "doc_id long, text string, lang string")
    out = {r.doc_id: r for r in language_id.held_out_languages(docs).collect() if r.doc_id is not None}
    learned = [(t or "", lang) for i, t, lang in [*LANG_ROWS, (7, None, "en"), (100, "12 34 !?", "de")] if zlib.crc32(str(i).encode()) % 5]
    counts = {lang: np.full(language_id.BUCKETS, language_id.SMOOTHING) for lang in ("de", "en")}
    for text, lang in learned:
        for gram, n in brute_grams(text).items():
            counts[lang][bucket_of(gram)] += n
    prior = collections.Counter(lang for _, lang in learned)
    for i, text, _ in [*LANG_ROWS[:9], *LANG_ROWS[-9:], (101, "the house and the dog", None)]:
        joint = {}
        for lang, c in counts.items():
            joint[lang] = math.log(prior[lang] / len(learned)) + sum(n * math.log(c[bucket_of(g)] / c.sum()) for g, n in brute_grams(text).items())
        best = max(joint, key=joint.get)
        share = 1 / sum(math.exp(v - joint[best]) for v in joint.values())
        assert out[i].lang_pred == best and abs(out[i].score - share) < 1e-4
        assert out[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
    assert (out[100].lang_pred, out[100].score) == ("und", 0.0)


def test_language_of_awkward_rows(spark):
    schema = "doc_id long, text string, lang string, score string, lang_pred int"
    assert language_id.held_out_languages(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, "no id", "en", "s", 1), (1, None, None, "s", 1), (2, "", "en", "s", 1), (3, "x" * 500_000, "en", "s", 1), (3, "x" * 500_000, "en", "s", 1)]
    out = language_id.held_out_languages(spark.createDataFrame(rows, schema), ("doc_id", "score", "lang_pred"))
    assert out.columns == ["doc_id", "score_in", "lang_pred_in", "held_out", "lang_pred", "score"]
    got = out.collect()
    assert len(got) == 5 and sum(r.lang_pred == "und" for r in got) >= 2
    nothing = language_id.held_out_languages(spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")).first()
    assert (nothing.lang_pred, nothing.score) == ("und", 0.0)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = language_id.held_out_languages(docs, ("doc_id", "lang")).where("held_out and lang is not null and lang_pred <> 'und'")
    right, n = out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 100 and right >= 0.98


# ---- hard negatives ----------------------------------------------------------------------------


def brute_negatives(rows, every=50):
    fit = []
    for vec_id, v, label in rows:
        if vec_id is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        fit.append((vec_id, (label + 1) % 10 if vec_id % 7 == 0 else label, [math.floor(256 * x) if abs(x) < 2**60 else math.floor(x) * 256 for x in v]))
    out = []
    for a, (aid, alabel, av) in enumerate(fit):
        if aid % every:
            continue
        scored = [(sum(x * y for x, y in zip(av, bv, strict=False)), bid, blabel) for b, (bid, blabel, bv) in enumerate(fit) if b != a]
        scored.sort(key=lambda s: (-s[0], s[1]))
        for p in [s for s in scored if s[2] == alabel][:5]:
            held = [s for s in scored if s[2] != alabel and 50 * p[0] <= 100 * s[0] <= 95 * p[0]][:3]
            out += [(aid, p[1], i, s[1], p[0], s[0]) for i, s in enumerate(held, 1)]
    return out


SCHEMA12 = "vec_id long, embedding array<float>, label int, v string, cell int"


def vectors(n, seed, dims=6, clusters=7):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, dims))
    return [(i, [float(np.float32(x)) for x in centres[i % clusters] * (1 if i % 3 else 0.4) + rng.normal(scale=0.15, size=dims)], int(rng.integers(0, 4))) for i in range(n)]


def mined(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA12)
    return collections.Counter(tuple(r) for r in hard_negative.mine(hard_negative.take_part(df), **kw).collect())


def test_hard_negatives_by_brute_force(spark):
    rows = vectors(700, 1)
    rows += [(900, None, 1), (901, [None] * 6, 1), (902, [float("nan")] * 6, 2), (903, [float("inf")] * 6, 2), (None, rows[0][1], 1), (950, rows[3][1], None)]
    rows += [rows[50], rows[50], rows[100], (50, rows[51][1], 3), (1000, rows[50][1], rows[50][2]), (1050, [0.0] * 6, 1), (1100, [0.5, 0.25], 2)]
    want = collections.Counter(brute_negatives(rows))
    assert len(want) > 50
    assert mined(spark, rows) == want
    assert mined(spark, rows, group_rows=4, block_rows=(16, 32)) == want  # many tiles, split cells


def test_hard_negatives_beyond_doubles(spark):
    rows = [(i, [float(np.float32(x * 3e6)) for x in v], label) for i, v, label in vectors(160, 2, dims=3)]
    want = collections.Counter(brute_negatives(rows))
    assert want and mined(spark, rows) == want
    assert mined(spark, [(0, [3e38], 2), (1, [3e38], 1), (2, [2.5e38], 2), (50, [-1.0], 1)]) == collections.Counter()  # the range of a saturated positive holds no score
    assert mined(spark, []) == collections.Counter()
    assert mined(spark, [(50, [1.0], 1)]) == collections.Counter()


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(5)
    x = np.floor(256 * (rng.normal(size=(12, 1, 8)) * 3 + rng.normal(scale=0.05, size=(12, 60, 8)))).reshape(-1, 8)
    labels = np.repeat(np.arange(12) % 3, 60)
    tree = hard_negative.Tree(x, labels, 16)
    nodes, seen = [tree.root], []
    while nodes:
        node = nodes.pop()
        seen.append(node)
        nodes += node.children
    for a, b in itertools.product(seen[::3], seen[::4]):
        low, high = hard_negative.interval(a, b)
        s = x[tree.order[a.start : a.stop]] @ x[tree.order[b.start : b.stop]].T
        assert low <= s.min() and s.max() <= high
    calls = []
    best = hard_negative.Best(len(x), 3, False)

    def leaves(a, b):
        calls.append((a, b))
        i, j = tree.order[a.start : a.stop], tree.order[b.start : b.stop]
        best.offer(i, x[i] @ x[j].T, j)

    hard_negative.search(tree, tree, lambda a, b, low, high: high >= best.score[tree.order[a.start : a.stop], -1].min(), leaves)
    n_leaves = sum(not n.children for n in seen)
    assert len(calls) < 0.5 * n_leaves**2  # whole groups are pruned where the data have structure
    whole = x @ x.T
    for i in range(len(x)):
        assert best.ids[i].tolist() == sorted(range(len(x)), key=lambda j: (-whole[i, j], j))[:3]


# ---- conversations -----------------------------------------------------------------------------


def brute_repair(rows):
    """rows: (turn, role, text) after damage, in order. Cheapest edits by search over (rows read, state)."""
    faults, seen = [], set()
    for _, role, text in rows:
        tail = text.rstrip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not tail else "duplicate" if (role, text) in seen else "truncated" if tail[-1] not in ".!?" else "")
        seen.add((role, text))
    best = {("S"): (0, "", [])}

    def inserted(states):
        out = dict(states)
        for _ in range(3):
            for s, (cost, audit, said) in list(out.items()):
                t, role = ("U", "user") if s != "U" else ("A", "assistant")
                new = (cost + 3, audit + "I", [*said, f"{role}:"])
                if t not in out or new[:2] < out[t][:2]:
                    out[t] = new
        return out

    for (_, role, text), fault in zip(rows, faults, strict=True):
        nxt = {}
        for s, (cost, audit, said) in inserted(best).items():
            options = [(s, cost + 4, "D", said)]
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                expected = "UA"[s == "U"]
                if role[:1] == "s" and s == "S":
                    options.append(("P", cost + more, "K", [*said, f"{role}:{text}"]))
                if role[:1] == expected.lower():
                    options.append((expected, cost + more, "K", [*said, f"{role}:{text}"]))
                new = {"U": "user", "A": "assistant"}[expected]
                if role != new:
                    options.append((expected, cost + 3 + more, "R", [*said, f"{new}:{text}"]))
            for t, c, letter, words in options:
                if t not in nxt or (c, audit + letter) < nxt[t][:2]:
                    nxt[t] = (c, audit + letter, words)
        best = nxt
    ends = inserted(best)
    cost, audit, said = min((ends[s] for s in ("S", "A") if s in ends), key=lambda x: x[:2])
    turns = [t for t, _, _ in rows if t is not None]
    legal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(k) for k in ("blank", "duplicate", "truncated")), legal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest())


def brute_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        d = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if d == 0:
            continue
        text = "" if d == 1 else "".join(c for c in text if c not in ".!?") if d == 2 else text
        out += [(turn, "user" if d == 4 else role, text)] * (2 if d == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))


def test_conversations_by_brute_force(spark):
    rng = random.Random(4)
    rows = []
    for conv in range(250):
        for turn in range(rng.choice([1, 2, 3, 6, 12])):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            rows.append((conv, rng.choice([turn, turn, turn + 3, None]), role, rng.choice(["Fine.", "Fine.", "cut off", "", " \t", None, "Why?", f"Row {turn}!"])))
    rows += [(None, None, None, None), (None, 1, "user", "Hi."), (None, 2, "assistant", "Hello."), (999, 0, "user", "Hi.\n"), (999, 0, "user", "Hi.\n"), (999, 1, "assistant", "é" * 100_000 + ".")]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "conv_id long, turn long, role string, text string, cost string, copies string").repartition(5)
    got = {r.conv_id: tuple(r)[1:] for r in conversation.damage_and_repair(df).collect()}
    by = collections.defaultdict(list)
    for r in rows:
        by[r[0]].append(r)
    assert set(got) == set(by)
    for conv, own in by.items():
        assert got[conv] == brute_repair(brute_damage(own)), conv


def test_repair_of_small_conversations_is_the_cheapest():
    """Every conversation of up to four rows over all roles and faults."""
    for n in range(5):
        for rows in itertools.product([("user", "A."), ("assistant", "B."), ("system", "C."), ("tool", "D"), ("user", "")], repeat=n):
            c = conversation.Conversation(1)
            seen = set()
            told = []
            for turn, (role, text) in enumerate(rows):
                c.row(turn, role, text, 1, not text.strip(), (role, text) in seen, text[-1:] not in ("", ".", "!", "?"))
                seen.add((role, text))
                told.append((turn, role, text))
            assert c.result()[1:] == brute_repair(told), rows


def test_long_conversation_keeps_little():
    chart = conversation.Chart()
    rng = random.Random(1)
    for i in range(20_000):
        chart.scan(rng.choice(["user", "assistant", "assistant", "tool"]), f"row {i}.", i % 11 == 0, i % 7 == 0)
        assert len(chart.items) <= 14 and max(len(d.audit) for d in chart.items.values()) < 2000
    cost, audit, _ = chart.repair()
    assert len(audit) >= 20_000 and cost > 0


def test_no_conversations(spark):
    assert conversation.damage_and_repair(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


# ---- caches, repeated ids ----------------------------------------------------------------------


def unspaced(n, size):
    rng = random.Random(9)
    return ["".join(rng.choice("的一是不了人我在有他这中大来上国abcdefgh0123+/") for _ in range(size)) for _ in range(n)]


def test_caches_are_bounded_in_bytes(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_BYTES", 2_000_000)
    monkeypatch.setattr(byte_bpe, "CACHE_BYTES", 2_000_000)
    monkeypatch.setattr(near_dup, "CACHE_BYTES", 1_000_000)
    encoder = tokens.ChunkEncoder(WORDS)
    library = tokens.tokenizer(WORDS)
    texts = unspaced(400, 2000)
    texts += [" ".join(f"w{i * 50 + j}" for j in range(50)) for i in range(600)]
    for at in range(0, len(texts), 50):
        part = texts[at : at + 50]
        for text, ids in zip(part, encoder.encode(part), strict=True):
            assert list(np.frombuffer(ids, np.uint32)) == library.encode(text, add_special_tokens=False).ids
        assert encoder.held < 4_000_000 and all(len(k) <= tokens.KEPT_CHARS for k in encoder.cache)
    import tiktoken

    bpe = byte_bpe.TextEncoder(BYTES, public_tokenizers.PATTERN)
    ranks = bpe.prefixes.ranks
    truth = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    short = unspaced(30, 600) + texts[400:]
    for at in range(0, len(short), 30):
        part = short[at : at + 30]
        for text, ids in zip(part, bpe.encode(part), strict=True):
            assert ids == truth.encode_ordinary(text)
        assert bpe.held < 6_000_000 and all(len(k) <= tokens.KEPT_CHARS for k in bpe.cache)
    near_dup._word_cache.cache_clear()
    for text in texts:
        near_dup.shingles(text)
    assert near_dup._word_cache()[None] < 1_200_000
    near_dup._word_cache.cache_clear()


def test_short_texts_do_not_collide():
    texts = [f"a{i} b{i * 7} c{i * 13}" for i in range(20_000)]
    assert len({s.tobytes() for s in near_dup.signatures(texts)}) == 20_000


def test_repeated_ids_meet_once(spark):
    base = " ".join(f"w{i}" for i in range(100))
    other = base.replace("w50", "x50")
    rows = [(1, base, "de")] * 40 + [(2, other, "en")] * 40 + [(3, base, "fr")] + [(4, "something else of its own", None)] * 3 + [(None, base, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, class_id string").repartition(4)
    out = collections.Counter(tuple(r) for r in near_dup.classes(docs).select("doc_id", "class_id").collect())
    assert out == {(1, 1): 40, (2, 1): 40, (3, 1): 1, (4, 4): 3, (None, 1): 1}
    kept = near_dup.classes(docs, keep=("doc_id", "class_id"))
    assert kept.columns == ["doc_id", "class_id_in", "class_id", "n_equal"] and kept.count() == len(rows)
    twice = spark.createDataFrame([(1,), (2,), (4,)], "id long")
    each = near_dup._one_each(docs, twice, "doc_id", "text")
    assert each.where("id is not null").count() == 4


def test_repeated_rows_of_line_dedup(spark):
    line = "this line is long enough to be a repeated boilerplate line"
    rows = [(None, f"{line}\nown")] * 50 + [(i, f"{line}\nown {i}") for i in range(6)]
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert out.count() == 56
    got = collections.Counter((r.doc_id, r.n_dropped, r.kept_text) for r in out.collect())
    assert got[(0, 1, "own 0")] == 1 and got[(5, 0, f"{line}\nown 5")] == 1


def test_sql_of_new_queries(spark):
    """The registered SQL of ops 12 and 13 on awkward tables."""
    duckdb = pytest.importorskip("duckdb")
    from tidewatch.llm import queries

    con = duckdb.connect()
    frame = pd.DataFrame([(i % 9, i // 9, ["user", "assistant", "system"][i % 3], ["Yes.", "no", "", "What?"][i % 4]) for i in range(80)], columns=["conv_id", "turn", "role", "text"])
    con.register("conversations", frame)
    want = con.sql(queries.oracle_sql()["op13_conversation_repair"])
    names = list(want.columns)
    got = conversation.damage_and_repair(spark.createDataFrame(frame))
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(want.fetchall())


# ---- licenses ----------------------------------------------------------------------------------


def test_whole_licenses_and_near_misses(spark):
    from tidewatch.llm import license_scan

    def body(label):
        """A license as it is written: the first of each alternative, optional regions left in, names where they belong."""
        out = license_scan.TEMPLATES[label].replace("<<beginOptional>>", "").replace("<<endOptional>>", "")
        return license_scan.MARKUP.sub(lambda m: m[3].split("|")[0] if m[3] else "the authors" if m[2] == "12" else "", out)

    whole = ["text:mit", "text:mit-0", "text:isc", "text:0bsd", "text:bsd-2-clause", "text:bsd-3-clause", "text:unlicense", "text:bsl-1.0", "text:zlib", "text:wtfpl", "text:apache-2.0", "text:gpl-3.0"]
    texts = {label: f"Some project\n\n{body(label)}\n\nmore words" for label in whole}
    mit, zlib_, free, apache, gpl = (body(f"text:{n}") for n in ("mit", "zlib", "unlicense", "apache-2.0", "gpl-3.0"))
    disclaimer = mit.index("THE SOFTWARE IS PROVIDED")
    misses = {
        "json": mit[:disclaimer] + "The Software shall be used for Good, not Evil. " + mit[disclaimer:],
        "mit without disclaimer": mit[:disclaimer],
        "zlib without conditions": zlib_[: zlib_.index("The origin")],
        "unlicense with an exception": free.replace("by any means.", "by any means, except that nobody may sell it."),
        "apache changed": apache.replace("irrevocable", "revocable", 1),
        "gpl cut": gpl[: len(gpl) // 2],
        "gpl changed": gpl.replace("Everyone is permitted", "Nobody is permitted", 1),
    }
    assert all(text != mit for text in misses.values())
    texts |= misses
    terms = gpl[: gpl.index("END OF TERMS")]
    texts["gpl terms alone"] = terms
    docs = spark.createDataFrame([(k, v) for k, v in texts.items()], "doc_id string, text string")
    got = {r.doc_id: {x for x in r.labels.split(",") if x.startswith("text:") and not x.endswith("-notice")} for r in license_scan.license_scan(docs).collect()}
    for label in whole:
        assert got[label] == {label}, label
    assert got["gpl terms alone"] == {"text:gpl-3.0"}
    for name in misses:
        assert got[name] == set(), name
