"""Operators for training data: brute force, round trips, and awkward rows."""

import collections
import hashlib
import io
import itertools
import random
import tarfile
import zlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import byte_bpe, html_extract, license_scan, line_dedup, media, near_dup, packing, quality, token_counts, tokens, url_filter

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
LINE = "this line is long enough to be a repeated boilerplate line"
TEXTS = [
    "", None, "  ", "short", LINE, f" {LINE.upper()}\t\nown words {{}}", f"{LINE}\n{LINE}\nx", f"a\n{LINE} ", "é" * 50, "word " * 5000,
    "<|endoftext|> inside", "a\n\nb  c d", "日本語テキスト", "Released under the MIT License.", "x" * 3000, "same text here", "same text here",
]
SCHEMA = "doc_id long, text string, kept string, bucket int"


@pytest.fixture(scope="module")
def docs(spark):
    """Awkward rows, with extra columns whose names clash with the operators' own."""
    rows = [(i, t, "k", i) for i, t in enumerate(TEXTS)] + [(3, "short", "k", 3)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def all_texts(extra=()):
    return [t or "" for t in [*TEXTS, *extra]]


def test_everything_takes_an_empty_table(none):
    for df in (
        line_dedup.dedup_lines(none), token_counts.token_counts(none, WORDS, 5), packing.pack(none, WORDS), near_dup.classes(none), media.media(none)[0],
        license_scan.license_scan(none), byte_bpe.encode_decode(none, BYTES, public_tokenizers.PATTERN), quality.judge(none), html_extract.extract_text(none, ("doc_id",), "text"),
    ):
        assert df.count() == 0


def test_line_dedup_by_brute_force(docs):
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    white = " \t\n\x0b\x0c\r"
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(white))
    holders = collections.defaultdict(list)
    for doc, text in rows:
        for k in {key(x) for x in text.split("\n")}:
            if len(k) >= 40:
                holders[k].append(doc)
    for least in (2, 4, 5):
        hot = {k: max(v) for k, v in holders.items() if len(v) >= least}
        want = collections.Counter()
        for doc, text in rows:
            lines = text.split("\n")
            kept = [x for x in lines if key(x) not in hot or hot[key(x)] == doc]
            want[doc, len(lines), len(lines) - len(kept), "\n".join(kept)] += 1
        got = line_dedup.dedup_lines(docs, ("doc_id", "kept"), min_docs=least, batches=5)
        assert collections.Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in got.collect()) == want


def test_token_counts_and_resynchronisation(docs):
    tok = tokens.tokenizer(WORDS)
    got = by_id(token_counts.token_counts(docs, WORDS, 100, keep=("doc_id", "bucket")))
    for i, t in enumerate(all_texts()):
        assert got[i].n_tokens == len(tok.encode(t, add_special_tokens=False).ids)
        assert (got[i].n_bytes, got[i].over_limit) == (len(t.encode()), got[i].n_tokens > 100)
    rng = random.Random(5)
    hard = ["".join(rng.choice("ab's'lé \n1!~́İßΣ日ก") for _ in range(3000)) for _ in range(8)]
    for t in [*hard, "x" * 4000, "a'" * 2000, "<|endoftext|>" * 200, " " * 2000, "e" * 500 + "́" * 60 + " end"]:
        want = len(tok.encode(t, add_special_tokens=False).ids)
        assert [token_counts.count_huge(WORDS, t, c, o) for c, o in ((400, 64), (333, 40))] == [want, want]


def test_word_encoder_gives_the_ids_of_the_library():
    tok, encoder, rng = tokens.tokenizer(WORDS), tokens.ChunkEncoder(WORDS), random.Random(7)
    signs = [*"abcABCzKIſİıßΣσςéÉ'’.,;:!?#*%&$|<>()-_019 \n\t\r\u0327\u0301ﬁ漢가Å\u200d", "'s", "'ll", "$$$", "the", "THE", "<|", "Word"]
    for _ in range(5):
        texts = ["".join(rng.choices(signs, k=rng.randint(0, 60))) for _ in range(500)]
        for t, ids in zip(texts, encoder.encode(texts), strict=True):
            assert ids == b"".join(x.to_bytes(4, "little") for x in tok.encode(t, add_special_tokens=False).ids)


def test_packing(docs):
    rows = packing.pack(docs, WORDS, 64, with_ids=True).collect()
    tok = tokens.tokenizer(WORDS)
    parts = collections.defaultdict(list)
    for r in rows:
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length
        parts[r.doc_id].append(r)
    for i, t in enumerate(all_texts()):
        ids = [*tok.encode(t, add_special_tokens=False).ids, 0]
        mine = sorted(parts[i], key=lambda r: r.piece)[:: 2 if i == 3 else 1]
        assert b"".join(bytes(r.ids) for r in mine) == b"".join(x.to_bytes(4, "little") for x in ids)
        assert all(r.length == 64 for r in mine[:-1])
    for _, group in itertools.groupby(sorted(rows, key=lambda r: (r.sequence_id, r.offset)), key=lambda r: r.sequence_id):
        at = 0
        for r in group:
            assert r.offset == at
            at += r.length
        assert at <= 64


def test_plan_is_best_fit_decreasing():
    rng = random.Random(3)
    for _ in range(30):
        cap = rng.choice([10, 50, 200])
        counts = {rng.randint(1, cap): rng.randint(1, 40) for _ in range(rng.randint(1, 20))}
        plan = packing.plan(counts, cap)
        free = []
        for length in sorted((x for x, n in counts.items() for _ in range(n)), reverse=True):
            fit = [i for i, f in enumerate(free) if f >= length]
            if fit:
                free[min(fit, key=lambda i: free[i])] -= length
            else:
                free.append(cap - length)
        assert max(r[4] + r[2] for r in plan) == len(free)
        assert sum(r[2] * r[3] for r in plan) == sum(counts.values())


def brute_classes(texts):
    parts = {k: near_dup.weighted(t) for k, t in texts.items()}
    root = {k: k for k in texts}
    for a, b in itertools.combinations(sorted(texts), 2):
        if root[a] != root[b] and near_dup.alike(parts[a], parts[b]):
            low, high = sorted((root[a], root[b]))
            root = {k: low if v == high else v for k, v in root.items()}
    return root


def test_near_duplicates_by_brute_force(spark):
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = {}
    for group in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([6, 60, 200]))]
        for _ in range(8):
            copy = base[:]
            for _ in range(rng.choice([0, 1, 2, 6])):
                copy[rng.randrange(len(copy))] = f"new{rng.random()}"
            texts[len(texts)] = " ".join(copy)
    texts |= {len(texts) + i: t or "" for i, t in enumerate(TEXTS)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in near_dup.classes(df).collect()}
    assert got == brute_classes(texts)


def test_second_pass_links_what_stars_miss():
    rows = []
    words = [f"v{i}" for i in range(100)]
    for i in range(12):  # neighbours are alike, the ends are not
        rows.append((0, i, i, " ".join(words[i * 3 :] + [f"t{k}" for k in range(i * 3)])))
    want = brute_classes({r[1]: r[3] for r in rows})
    assert linked(near_dup._links(rows), 12) == want and len(near_dup._links(rows)) < len(rows)


def linked(links, n):
    root = {i: i for i in range(n)}
    for a, b in links:
        low, high = sorted((root[a], root[b]))
        root = {k: low if v == high else v for k, v in root.items()}
    return root


def test_common_weight_bounds_probability_jaccard():
    """No pair that is alike is passed over because of its common weight, however lumpy its texts are."""
    rng = random.Random(8)
    rows = []
    for i in range(40):
        base = [f"w{k}" for k in range(30)] * rng.choice([1, 2, 5]) + [f"x{rng.randrange(6)}" for _ in range(rng.randrange(12))]
        rows.append((0, i, i, " ".join(base + ["same five words come again"] * rng.randrange(4))))
    parts = [near_dup.weighted(r[3]) for r in rows]
    for a, b in itertools.combinations(parts, 2):
        common = sum(min(w, dict(zip(b[0].tolist(), b[1].tolist(), strict=True)).get(k, 0)) for k, w in zip(a[0].tolist(), a[1].tolist(), strict=True))
        assert near_dup.probability_jaccard(a, b) <= common + 1e-9
    assert linked(near_dup._links(rows), 40) == brute_classes({r[1]: r[3] for r in rows})


def test_registers_estimate_probability_jaccard():
    a = " ".join(f"x{i % 50}" for i in range(400))
    b = " ".join(f"x{i % 50}" if i % 10 else f"y{i}" for i in range(400))
    exact = near_dup.probability_jaccard(near_dup.weighted(a), near_dup.weighted(b))
    sig = near_dup.signatures([a, b], 4096)
    assert abs((sig[0] == sig[1]).mean() - exact) < 0.04
    p, q = (dict(zip(*map(list, near_dup.weighted(t)), strict=True)) for t in (a, b))
    brute = sum(1 / sum(max(p.get(y, 0) / p[x], q.get(y, 0) / q[x]) for y in {*p, *q}) for x in p if x in q)
    assert abs(exact - brute) < 1e-9


L = "Something happened in the town on Tuesday, and nobody could explain it. The mayor said that the matter would be looked into, but gave no date."
M = "Later that evening, a second report came in. It said that two people had seen the same thing, near the old bridge, and that they had told the police."
# hand-labelled pages: (html, main text)
PAGES = {
    "unclassed div": (f"<html><body><div><p>{L}</p><p>{M}</p></div></body></html>", f"{L}\n{M}"),
    "fragment": (f"<article><p>{L}</p></article>", L),
    "paragraphs alone": (f"<p>{L}</p><p>{M}</p>", f"{L}\n{M}"),
    "bare body": (f"<html><body>{L}</body></html>", L),
    "bare body and paragraph": (f"<html><body>{L}<p>{M}</p></body></html>", f"{L}\n{M}"),
    "span under body": (f"<html><body><span>{L}</span></body></html>", L),
    "no markup": (L, L),
    "table": (f"<html><body><table><tr><td><p>{L}</p><p>{M}</p></td></tr></table></body></html>", f"{L}\n{M}"),
    "inline advert and share link": (f"<html><body><div class='content'><p>{L}</p><span class='ad'>Buy now cheap</span><p>{M} <a class='share' href='/s'>Share this</a></p></div></body></html>", f"{L}\n{M}"),
    "nav, plain div, footer": (f"<html><body><nav><a href='/'>Home</a> <a href='/b'>Blog</a></nav><div><h1>Odd lights</h1><p>{L}</p><p>{M}</p></div><footer>Copyright 2024</footer></body></html>", f"Odd lights\n{L}\n{M}"),
    "three wrappers": (f"<html><body><div><div><div><h2>Odd lights</h2><p>{L}</p></div></div></div></body></html>", f"Odd lights\n{L}"),
    "links and lists inside": (f"<html><body><main><p>{L} See <a href='/x'>the earlier report</a> for more.</p><ul><li>First point of the day</li><li>Second point</li></ul></main></body></html>", f"{L} See the earlier report for more.\nFirst point of the day\nSecond point"),
    "unclassed menu": (f"<html><body><ul><li><a href='/'>Home</a></li><li><a href='/a'>About</a></li><li><a href='/c'>Contact</a></li></ul><div><p>{L}</p><p>{M}</p></div></body></html>", f"{L}\n{M}"),
    "notice and comments": (f"<html><body><div class='cookie-banner'>We use cookies.</div><section><h1>T one</h1><p>{L}</p></section><section class='comments'><p>Nice post, thanks a lot!</p></section></body></html>", f"T one\n{L}"),
    "short": ("<html><body><p>Hello there.</p></body></html>", "Hello there."),
    "two articles": (f"<html><body><nav><a href='/'>Home</a></nav><article><h2>One</h2><p>{L}</p></article><article><h2>Two</h2><p>{M}</p></article></body></html>", f"One\n{L}\nTwo\n{M}"),
    "no main text": ("<html><body><nav><ul><li><a href='/'>Home</a></li><li><a href='/a'>About us</a></li></ul></nav><footer>&copy; 2024 Example</footer></body></html>", ""),
    "definitions": (f"<html><body><div class='entry'><p>{L}</p><dl><dt>Bridge</dt><dd>Where the two people stood that evening.</dd></dl></div></body></html>", f"{L}\nBridge\nWhere the two people stood that evening."),
    "code and aside": (f"<html><body><main><p>{L}</p><pre>x = 1\ny = 2</pre></main><aside><h3>Related</h3><ul><li><a href='/q'>Old lights</a></li></ul></aside></body></html>", f"{L}\nx = 1 y = 2"),
    "aside inside": (f"<html><body><article><p>{L}</p><aside class='related'><p>Read more about lights here</p></aside><p>{M}</p></article></body></html>", f"{L}\n{M}"),
    "sidebar cell": (f"<html><body><table><tr><td class='sidebar'><a href='/'>Home</a><br><a href='/b'>Blog</a></td><td><p>{L}</p><p>{M}</p></td></tr></table></body></html>", f"{L}\n{M}"),
    "many paragraphs": ("<html><body><div id='main'>" + "".join(f"<p>{L} {i}</p>" for i in range(2000)) + "</div><div id='footer'>Imprint and contact</div></body></html>", "\n".join(f"{L} {i}" for i in range(2000))),
    "old tags": (f"<html><body><center><font size=2>{L}</font></center><p><i>{M}</i></p></body></html>", f"{L}\n{M}"),
    "line breaks": (f"<html><body><div id='content'>{L}<br><br>{M}</div></body></html>", f"{L} {M}"),
    # names of body and article that only describe a state or a kind, headers of articles, overviews, formulas, comment lists
    "body of a theme": (f"<body class='single no-sidebar'><div class='wrap'><p>{L}</p><p>{M}</p></div></body>", f"{L}\n{M}"),
    "article with categories": (f"<article class='post tag-comments category-notice'><p>{L}</p><p>{M}</p></article>", f"{L}\n{M}"),
    "states of body": (f"<body class='page with-sidebar has-header'><h1>Odd lights</h1><p>{L}</p></body>", f"Odd lights\n{L}"),
    "header of an article": (f"<html><body><header class='site-header'><a href='/'>The Daily</a></header><article><header><h1>Odd lights</h1></header><p>{L}</p><p>{M}</p></article></body></html>", f"Odd lights\n{L}\n{M}"),
    "overview": ("<html><body><nav><ul><li><a href='/'>Home</a></li></ul></nav><div class='content'><h1>All reports</h1><ul><li><a href='/1'>How the river was crossed</a></li><li><a href='/2'>What the farmers said about it</a></li><li><a href='/3'>Why the bridge stands again</a></li></ul></div></body></html>", "All reports\nHow the river was crossed\nWhat the farmers said about it\nWhy the bridge stands again"),
    "formula": (f"<body><article><p>{L}</p><p>Here <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds for all of them.</p></article></body>", f"{L}\nHere x=2 holds for all of them."),
    "comment list": (f"<body><article><p>{L}</p><p>{M}</p></article><ol class='commentlist'><li>Anna<p>I liked this story a lot, thank you.</p></li><li>Bob<p>Me too, it was good to read.</p></li></ol></body>", f"{L}\n{M}"),
    "logged in": (f"<html><body class='post-template-default single single-post logged-in has-ads'><div id='page'><div class='site-content'><p>{L}</p><p>{M}</p></div></div></body></html>", f"{L}\n{M}"),
    "layout names": (f"<html><body class='layout-sidebar-right'><div class='row'><div class='col-md-8'><h1>Odd lights</h1><p>{L}</p><p>{M}</p></div></div></body></html>", f"Odd lights\n{L}\n{M}"),
    "archive of a tag": (f"<html><body class='archive tag tag-popup'><main><h2>Odd lights</h2><p>{L}</p></main></body></html>", f"Odd lights\n{L}"),
    "entry header class": (f"<html><body><article class='hentry'><div class='entry-header'><h1>Odd lights</h1></div><div class='entry-content'><p>{L}</p><p>{M}</p></div></article></body></html>", f"Odd lights\n{L}\n{M}"),
    "site footer": (f"<html><body><div class='entry'><p>{L}</p><p>{M}</p></div><div class='site-footer'><p>Imprint, contact and the terms of use of this site.</p></div></body></html>", f"{L}\n{M}"),
    "comments area": (f"<html><body><main><p>{L}</p><p>{M}</p></main><div id='comments' class='comments-area'><p>First of all, thank you for this.</p><p>What about the other bridge?</p></div></body></html>", f"{L}\n{M}"),
    "sidebar beside": (f"<html><body><div class='content'><p>{L}</p><p>{M}</p></div><div class='sidebar'><h3>Popular</h3><ul><li><a href='/1'>Old lights</a></li><li><a href='/2'>New lights</a></li></ul></div></body></html>", f"{L}\n{M}"),
    "section with heading": (f"<html><body><section><h2>Odd lights</h2><p>{L}</p><p>{M}</p></section></body></html>", f"Odd lights\n{L}\n{M}"),
    "quoted": (f"<html><body><article><p>{L}</p><blockquote><p>{M}</p></blockquote></article></body></html>", f"{L}\n{M}"),
    "footnote": (f"<html><body><main><p>{L}</p><p>{M}<sup>2</sup></p></main></body></html>", f"{L}\n{M}2"),
    "ordered steps": (f"<html><body><article><h1>How to do it</h1><p>{L}</p><ol><li>Take the first one out of the box.</li><li>Put it where it belongs.</li></ol></article></body></html>", f"How to do it\n{L}\nTake the first one out of the box.\nPut it where it belongs."),
    "newsletter box": (f"<html><body><article><p>{L}</p><p>{M}</p></article><div class='newsletter'><p>Get our news by mail.</p><form><input><button>Go</button></form></div></body></html>", f"{L}\n{M}"),
    "breadcrumbs": (f"<html><body><div class='breadcrumbs'><ul><li><a href='/'>Home</a></li><li><a href='/n'>News</a></li><li><a href='/t'>Town</a></li></ul></div><article><h1>Odd lights</h1><p>{L}</p></article></body></html>", f"Odd lights\n{L}"),
    "cookie notice of a theme": (f"<body class='cookie-accepted'><div class='cookie-notice'><p>We use cookies to make this site work for you.</p><button>Fine</button></div><article><p>{L}</p><p>{M}</p></article></body>", f"{L}\n{M}"),
    "picture with caption": (f"<html><body><article><p>{L}</p><figure><img src='a.png'><figcaption>The bridge at night, seen from the hill.</figcaption></figure><p>{M}</p></article></body></html>", f"{L}\nThe bridge at night, seen from the hill.\n{M}"),
    "role main": (f"<html><body><div role='navigation'><ul><li><a href='/'>Home</a></li><li><a href='/b'>Blog</a></li></ul></div><div role='main'><p>{L}</p><p>{M}</p></div></body></html>", f"{L}\n{M}"),
    "camel case": (f"<html><body><div id='mainContent'><p>{L}</p><p>{M}</p></div></body></html>", f"{L}\n{M}"),
    "long words": (f"<html><body><article><p>{'Donaudampfschiff' * 30} is a word.</p><p>{L}</p></article></body></html>", f"{'Donaudampfschiff' * 30} is a word.\n{L}"),
    "two holders": (f"<html><body><div class='text'><p>{L}</p></div><div class='text'><p>{M}</p></div></body></html>", f"{L}\n{M}"),
    "paragraphs in a form of a page": (f"<html><body><form id='aspnetForm'><div id='wrapper'><div class='article-body'><p>{L}</p><p>{M}</p></div></div></form></body></html>", f"{L}\n{M}"),
}


def test_html(spark):
    trees = html_extract.model()
    page = (
        "<html><head><title>T</title><script>var a='</p>';</script></head><body><nav><ul><li><a href='/'>Home</a><li><a href='/b'>More</a></ul></nav>"
        "<div class='cookie-notice'><p>We use cookies.</p></div><article><h1>Head &amp; tail</h1><p>First  paragraph,\n with <b>bold</b> words.<p>Second one, it is longer than that.</p></article>"
        "<div class='comments'><p>Nice post!</p></div><footer>&copy; 2024</footer></body></html>"
    )
    deep = "<div>" * 5000 + "x"
    got = html_extract.extract([page, "", "<p", deep], trees)
    assert got[0] == "Head & tail\nFirst paragraph, with bold words.\nSecond one, it is longer than that."
    assert got[1] == ""
    rows = [(name, html) for name, (html, _) in PAGES.items()] + [("table", PAGES["table"][0]), ("null", None)]
    out = html_extract.extract_text(spark.createDataFrame(rows, "page_id string, html string"), ("page_id",), trees=trees).collect()
    want = collections.Counter((name, PAGES.get(name, ("", ""))[1]) for name, _ in rows)
    assert collections.Counter((r.page_id, r.text) for r in out) == want
    assert all(r.n_chars == len(r.text) for r in out)
    x, y = html_extract.training_rows(60, seed=77)
    assert ((trees.probability(x) > 0.5) == (y > 0.5)).mean() > 0.97  # held-out pages


def test_media_round_trip(docs):
    rows, folder = media.media(docs)
    for r in rows.collect():
        data = (TEXTS[r.doc_id] or "").encode()
        payload = data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))
        assert (r.n_bytes, r.payload_bytes) == (len(data), len(payload))
        assert r.payload_sha256 == r.digest == hashlib.sha256(payload).hexdigest()
        assert r.tail_crc32 == zlib.crc32(payload[-64:]) and r.media_height * 64 == len(payload)
        with open(f"{folder.removeprefix('file://')}/{r.shard}", "rb") as shard:
            found = {m.name: tar.extractfile(m).read() for tar in [tarfile.open(fileobj=io.BytesIO(shard.read()))] for m in tar.getmembers()}
        stored = found[f"{r.digest}.png"]
        assert r.length == len(stored)
        assert (len(stored), hashlib.sha256(stored).hexdigest()) == (r.media_bytes, r.media_sha256)


def test_equal_payloads_lie_in_one_place(spark):
    rows = spark.createDataFrame([(i, "the same text" if i % 3 else f"text {i}") for i in range(60)], "doc_id long, text string").repartition(7)
    places = collections.defaultdict(set)
    for r in media.media(rows)[0].collect():
        places[r.digest].add((r.shard, r.offset, r.length, r.media_sha256))
    assert len(places) == 21 and all(len(p) == 1 for p in places.values())
    with pytest.raises(Exception):  # noqa: B017
        media._store("unknown-scheme://x/y")


def test_runs_are_reopened(spark):
    keys = lambda a, b: spark.range(a, b).select(F.col("id").alias("doc_id"), F.xxhash64(F.col("id") % 50).alias("h1"), F.xxhash64(F.lit("s"), F.col("id") % 50).alias("h2"))
    runs = line_dedup.LineRuns(spark, buckets=3)
    for a in range(0, 210, 30):
        runs.add(keys(a, a + 30))
    known = sorted(map(tuple, runs.keys().collect()))
    runs.release()
    again = line_dedup.LineRuns.reopen(spark, runs.folder)
    assert sorted(map(tuple, again.keys().collect())) == known and len(known) == 50 and sum(k[2] for k in known) == 210
    own = again._write(keys(0, 10).groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("last_doc")))
    unseen = again.unseen(again._read(own))
    plan = unseen._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Sort [" not in plan and "Exchange" not in plan
    assert unseen.count() == 0
    again.add(keys(200, 260))
    assert sum(r.n_docs for r in again.keys().collect()) == 270
    again.close()
    assert spark.conf.get(line_dedup.ORDERING, "false") == "false"


def test_url_filter_as_of(spark):
    captures = spark.createDataFrame(
        [(1, "http://a.ex.com/x/y", "2024-01-05"), (2, "http://a.ex.com/x/y", "2024-01-10"), (3, "HTTP://u@A.EX.COM.:80/z", "2024-02-01"), (4, None, "2024-01-05"), (5, "http://other.org/", None), (5, "http://notex.com/", "2024-01-10")],
        "page_id int, url string, day string",
    ).withColumn("fetched_on", F.col("day").cast("date"))
    entries = spark.createDataFrame(
        [("ex.com", "2024-01-06", "block"), ("ex.com", "2024-01-20", "none"), ("a.ex.com/x/", "2024-01-09", "allow"), ("ex.com", "2024-01-25", "block"), (None, "2024-01-01", "block")], "pattern string, day string, verdict string"
    ).withColumn("entry_date", F.col("day").cast("date"))
    got = sorted((r.page_id, r.blocked, r.list_pattern or "") for r in url_filter.judge(captures, entries).collect())
    assert got == [(1, False, ""), (2, False, "a.ex.com/x/"), (3, True, "ex.com"), (4, False, ""), (5, False, ""), (5, False, "")]
    assert url_filter.judge(captures, entries.limit(0)).where("blocked").count() == 0


def test_license_templates(docs):
    got = by_id(license_scan.license_scan(docs, with_spans=True))
    assert (got[13].base_labels, got[13].labels, got[13].n_base, got[13].first_word, got[13].score) == ("mit", "mit,notice:mit", 1, 3, 1.0)
    assert (got[1].n_words, got[1].n_base, got[1].first_word, got[1].labels) == (0, 0, None, "")
    one = license_scan.compile_template("t", "a <<beginOptional>>b <<beginOptional>>c <<endOptional>><<endOptional>><<var;most=2>> d")
    # brute force: all wordings that the markup allows
    allowed = {tuple(["a", *o, *v, "d"]) for o in ([], ["b"], ["b", "c"]) for n in range(3) for v in itertools.product("abcdz", repeat=n)}
    for n in range(2, 6):
        for words in itertools.product("abcdz", repeat=n):
            ends = [len(w) for w in allowed if words[: len(w)] == w]
            assert one.match(list(words), 0) == max(ends, default=-1)


def template_pattern(template):
    """The same markup as a regular expression over words that end with a blank: what the automaton must agree with."""
    import re

    out, pos = "", 0
    say = lambda text: "".join(re.escape(w) + " " for w in license_scan.words_of(text))
    for m in [*license_scan.MARKUP.finditer(template), None]:
        out += say(template[pos : m.start() if m else len(template)])
        if m is None:
            return re.compile(out)
        pos = m.end()
        if m[1] == "beginOptional":
            out += "(?:"
        elif m[1] == "endOptional":
            out += ")?"
        elif m[3] is not None:
            out += "(?:" + "|".join(say(o) for o in m[3].split("|")) + ")"
        else:
            out += r"(?:\S+ ){0,%s}" % m[2]


def test_licenses_by_brute_force(spark):
    """Whole results against regular expressions and a plain search, on license texts with words lost, added and changed."""
    rng = random.Random(6)
    tokens_of = lambda k: license_scan.words_of(license_scan.MARKUP.sub(lambda m: (m[3] or " ").split("|")[0], license_scan.TEMPLATES[k]))
    texts = ["", "MIT License mit license GNU General Public License", "apache license " * 3000]
    for k in license_scan.TEMPLATES:
        for lost in (0, 0, 1):
            words = tokens_of(k)
            for _ in range(lost):
                words.pop(rng.randrange(len(words)))
            texts.append(" ".join(["some", "prose", *words, "and", "cc", "by", "more", *tokens_of(rng.choice(list(license_scan.TEMPLATES)))]))
    texts += [texts[5], texts[5]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    patterns = {k: template_pattern(v) for k, v in license_scan.TEMPLATES.items()}
    got = by_id(license_scan.license_scan(docs, with_spans=True))
    hits = 0
    for i, text in enumerate(texts):
        words = license_scan.words_of(text)
        places = [(a, label) for phrase, label in license_scan.PHRASES.items() for a in range(len(words)) if words[a : a + len(phrase.split())] == phrase.split()]
        joined, starts, at = "".join(w + " " for w in words), [], 0
        for w in words:
            starts.append(at)
            at += len(w) + 1
        spans = set()
        for k, pattern in patterns.items():
            free = 0
            for a in range(len(words)):
                # regular expressions take the first way, automata the longest: try every end
                m = next((e for e in range(len(words), a, -1) if pattern.fullmatch(joined, starts[a], starts[e] if e < len(words) else at)), None) if a >= free and pattern.match(joined, starts[a]) else None
                if m is not None:
                    spans.add((k, a, m))
                    free = m
        r = got[i]
        assert {(x.label, x.start, x.end) for x in r.spans} == spans
        hits += len(spans)
        covered = {w for _, a, b in spans for w in range(a, b)} | {a + d for a, label in places for p, lab in license_scan.PHRASES.items() if lab == label for d in range(len(p.split()))}
        base = sorted({label for _, label in places})
        assert (r.n_words, r.n_base, r.base_labels, r.labels) == (len(words), len(places), ",".join(base), ",".join(sorted({*base, *(k for k, _, _ in spans)})))
        assert (r.first_word, r.last_word) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert r.score == (len(covered) / len(words) if words else 0.0)
    assert hits > 2 * len(patterns)
    automata = [license_scan.compile_template(k, v) for k, v in license_scan.TEMPLATES.items()]
    told = {k: {x[0] for x in license_scan.scan(tokens_of(k), automata)} for k in license_scan.TEMPLATES}
    assert all(k in told[k] for k in told)
    assert told["text:bsd-3-clause"] == {"text:bsd-3-clause"} and told["text:bsd-2-clause"] == {"text:bsd-2-clause"}
    assert told["text:lgpl-3.0-notice"] == {"text:lgpl-3.0-notice"}


def test_byte_bpe(docs):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(BYTES, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = by_id(byte_bpe.encode_decode(docs, BYTES, public_tokenizers.PATTERN, with_ids=True))
    for i, t in enumerate(all_texts()):
        assert got[i].ids == library.encode_ordinary(t)
        assert got[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
    own = byte_bpe.prefix_encoder(BYTES)
    whole = " unbelievable appended".encode()
    entries = own.extend(own.extend([], whole[:7]), whole)  # appending is exact
    assert entries == own.extend([], whole)
    changed = " unbelievably appended!".encode()
    assert own.edited(entries, whole, changed) == own.extend([], changed)


def test_quality_by_brute_force(docs):
    import re

    for r in quality.judge(docs, ("doc_id", "text", "kept")).select("doc_id", "text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect():
        text = r.text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = collections.Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
        repeated = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(words), sum(map(len, words)), len(repeated))
        assert (r.n_symbols, r.n_dup_lines) == (len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)))
        assert r.base_failed == (len(words) < 10 or 100 * len(repeated) > 20 * len(words))


def test_common_words_decide_long_texts(spark):
    rng = random.Random(4)
    rare = ["".join(rng.choice("abcdefghilmnoprstu") for _ in range(7)) for _ in range(2000)]
    usual = ["the", "of", "and", "to", "in", "is", "for", "with", "this"]
    prose = [rng.choice(usual) if rng.random() < 0.1 else rng.choice(rare) for _ in range(400)]
    texts = {1: prose, 2: rng.choices(rare, k=400), 3: rng.choices(rare, k=quality.MIN_WORDS_FOR_COMMON - 1), 4: rng.choices(usual, k=400)}
    # common words count in any case and next to punctuation
    texts[5] = [rng.choice(["The", "(of", "and,", "to.", "“IN", "is;", "for:", "With", "this!"]) if x in usual else x for x in prose]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id long, text string")
    got = by_id(quality.judge(docs))
    assert {i: got[i].kept for i in texts} == {1: True, 2: False, 3: True, 4: False, 5: True}
    assert not any(got[i].base_failed for i in (1, 2, 3, 5))
    assert got[5].common_distance < got[2].common_distance


def test_pipeline_stages(spark):
    import corpus_pipeline

    rng = random.Random(2)
    rare = lambda: "".join(rng.choice(["ta", "re", "min", "lo", "ven", "qua", "sti", "or"]) for _ in range(rng.randint(2, 4)))
    usual = ["the", "the", "of", "and", "to", "in", "is"]
    prose = lambda n: " ".join(rng.choice(usual) if rng.random() < 0.25 else rare() for _ in range(n))
    rows = [(i, prose(80), "en", "s", 0) for i in range(20)]
    rows += [(20, rows[0][1], "en", "s", 0), (21, "### $$$ " * 60, "en", "s", 0), (22, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.quality_rules(spark, docs, "")
    assert {r.doc_id for r in kept.collect()} == set(range(21)) and kept.columns == list(corpus_pipeline.COLUMNS)
    left = corpus_pipeline.drop_near_duplicates(spark, corpus_pipeline.dedup_lines(spark, kept, ""), "")
    assert {r.doc_id for r in left.collect()} == set(range(20)) and left.columns == list(corpus_pipeline.COLUMNS)
    assert {r.doc_id for r in corpus_pipeline.pack_sequences(spark, left, "").collect()} == set(range(20))


def test_url_filter_one_label_domains(spark):
    """A list entry of one label holds for its subdomains, and gives way to a longer one."""
    import datetime as dt

    day = dt.date(2024, 5, 5)
    urls = ["http://a.bad.zip/x", "http://zip/", "http://app.localhost:8080/", "http://good.zip/", "http://a.zip.org/", "http://azip/"]
    pages = spark.createDataFrame([(u, day) for u in urls], "url string, fetched_on date")
    entries = spark.createDataFrame([(p, day, v) for p, v in [("zip", "block"), ("localhost", "block"), ("good.zip", "allow")]], "pattern string, entry_date date, verdict string")
    out = {r.url: (r.list_pattern, r.blocked) for r in url_filter.judge(pages, entries).collect()}
    assert [out[u] for u in urls] == [("zip", True), ("zip", True), ("localhost", True), ("good.zip", False), (None, False), (None, False)]


def test_clashing_names(spark):
    """A kept column with a name of the result comes out with _in behind it, and the result's own keeps its name."""
    row = spark.createDataFrame([(1, "some words of a text that is long enough to be kept here", 7, 8, "x")], "doc_id long, text string, n_tokens int, n_words int, kept string")
    got = token_counts.token_counts(row, WORDS, 5, keep=("doc_id", "n_tokens")).first()
    assert (got.n_tokens_in, got.over_limit) == (7, True)
    assert byte_bpe.encode_decode(row, BYTES, public_tokenizers.PATTERN, keep=("doc_id", "n_tokens")).first().n_tokens_in == 7
    got = quality.judge(row, ("doc_id", "kept", "n_words")).first()
    assert (got.kept_in, got.n_words_in, got.n_words, got.kept) == ("x", 8, 13, True)
    got = license_scan.license_scan(row, ("doc_id", "n_words")).first()
    assert (got.n_words_in, got.n_words) == (8, 13)
    got = html_extract.extract_text(row, ("doc_id", "text"), "text").first()
    assert got.text_in == row.first().text == got.text
    lines = line_dedup.dedup_lines(row.withColumnsRenamed({"kept": "kept_text", "n_words": "n_lines"}), ("doc_id", "kept_text", "n_lines")).first()
    assert (lines.kept_text_in, lines.n_lines_in, lines.n_lines) == ("x", 8, 1)
    pages = spark.createDataFrame([("http://a.b/", "2024-01-01", "h")], "url string, day string, host string").withColumn("fetched_on", F.col("day").cast("date"))
    entries = spark.createDataFrame([("a.b", "2024-01-01", "block")], "pattern string, day string, verdict string").withColumn("entry_date", F.col("day").cast("date"))
    got = url_filter.judge(pages, entries).first()
    assert (got.host_in, got.host, got.blocked) == ("h", "a.b", True)


def test_missing_ids(spark):
    """Rows without doc_id count in line dedup and are never the last holder; near duplicates give them the class of an equal text."""
    rows = [(None, LINE), (None, LINE), (4, LINE), (9, LINE), (5, "quite another text, nothing like it"), (None, "a text of its own without any id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lines = sorted(line_dedup.dedup_lines(docs, min_docs=4).collect(), key=lambda r: (r.doc_id or 0, r.kept_text))
    assert [(r.doc_id, r.n_dropped) for r in lines] == [(None, 1), (None, 1), (None, 0), (4, 1), (5, 0), (9, 0)]
    found = collections.Counter((r.doc_id, r.class_id, r.n_equal) for r in near_dup.classes(docs).collect())
    assert found == {(None, 4, 4): 2, (4, 4, 4): 1, (9, 4, 4): 1, (5, 5, 1): 1, (None, None, 1): 1}


def test_url_filter_ties(spark):
    """Two entries of a pattern on one day: block beats allow, allow beats none. No captures give no rows."""
    import datetime as dt

    day = dt.date(2024, 5, 5)
    pages = spark.createDataFrame([(f"http://{h}.org/", day) for h in "abc"], "url string, fetched_on date")
    entries = spark.createDataFrame([(f"{h}.org", day, v) for h, vs in (("a", ("allow", "block")), ("b", ("none", "allow")), ("c", ("none", "block", "allow"))) for v in vs], "pattern string, entry_date date, verdict string")
    assert {r.url[7]: (r.blocked, r.list_verdict) for r in url_filter.judge(pages, entries).collect()} == {"a": (True, "block"), "b": (False, "allow"), "c": (True, "block")}
    assert url_filter.judge(pages.limit(0), entries).count() == 0


def test_pipeline_by_brute_force(spark, tmp_path):
    """run() over a small table against every stage in plain Python; repeated ids, equal rows and an empty table included."""
    import corpus_pipeline

    rng = random.Random(12)
    rare = lambda: "".join(rng.choice(["ta", "re", "min", "lo", "ven", "qua", "sti", "or"]) for _ in range(rng.randint(2, 4)))
    usual = ["the", "the", "of", "and", "to", "in", "is"]
    prose = lambda n: " ".join(rng.choice(usual) if rng.random() < 0.25 else rare() for _ in range(n))
    texts = [f"{LINE}\n{prose(90)}\nThe end" if i % 3 else prose(120) for i in range(24)]
    texts += [texts[1] + " more", texts[2].replace(" the ", " a ", 1), texts[0], "### $$$ " * 60, "", None, "too short"]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)] + [(2, prose(100), "en", "s", 0), (5, texts[5], "en", "s", 0)]
    path = str(tmp_path / "documents.parquet")
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(path)
    good = {r.text for r in quality.judge(spark.read.parquet(path), ("text",)).where("kept").collect()}  # itself held against brute force above
    kept = [(d, t) for d, t, *_ in rows if t in good]
    assert 20 < len(kept) < len(rows)
    holders = collections.defaultdict(list)
    for d, t in kept:
        for k in {x.strip().lower() for x in t.split("\n")}:
            if len(k) >= 40:
                holders[k].append(d)
    last = {k: max(v) for k, v in holders.items() if len(v) >= 5}
    cut = [(d, "\n".join(x for x in t.split("\n") if last.get(x.strip().lower(), d) == d)) for d, t in kept]
    assert cut != kept
    ids = sorted({d for d, _ in cut})
    root = {d: d for d in ids}
    for (a, x), (b, y) in itertools.combinations(sorted(set(cut)), 2):
        if root[a] != root[b] and (x == y or near_dup.alike(near_dup.weighted(x), near_dup.weighted(y))):
            low, high = sorted((root[a], root[b]))
            root = {k: low if v == high else v for k, v in root.items()}
    chosen = sorted({(d, t) for d, t in cut if root[d] == d})
    tok = tokens.tokenizer(WORDS)
    want = collections.Counter()
    for d, t in chosen:
        n = [*tok.encode(t, add_special_tokens=False).ids, 0]
        want.update((d, i // 2048, len(n[i : i + 2048]), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in n[i : i + 2048]))) for i in range(0, len(n), 2048))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert collections.Counter((r.doc_id, r.piece, r.length, r.ids_crc32) for r in out) == want
    assert {0, 2} <= {r.doc_id for r in out} and 26 not in {r.doc_id for r in out}
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
