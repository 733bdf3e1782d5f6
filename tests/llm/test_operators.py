"""Each operator against brute force on small fixtures, with nulls, empty and long texts, ties and clashing columns."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from finloom.llm import decontam, htmltext, licenses, linededup, mixing, neardup, pii, quality, registry, suffixes, toxicity

from . import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, extra=False, sources=None):
    rows = [(i, t, "en", (sources or ["a"])[i % len(sources or ["a"])], len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumns({"size": F.lit("x"), "text_": F.lit(1), "n_words": F.lit("clash"), "pii": F.lit(0), "kept": F.lit("k"), "score": F.lit("s")}) if extra else df


def words(rnd, n, vocabulary=400):
    return " ".join(f"w{rnd.randrange(vocabulary)}" for _ in range(n))


EDGE = [None, "", " ", "\n\n", "a", "é" * 70, "x" * 5000, "word " * 3000]


# --- 8

def plain_quality(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    cover = {i + o for i, g in enumerate(tri) if tri.count(g) > 1 for o in range(3)} if len(tri) < 2000 else None
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), None if cover is None else len(cover)


def test_quality(spark):
    rnd = random.Random(1)
    texts = EDGE + [words(rnd, 80), words(rnd, 60) + " | # $ %" * 9, "UP " + "DOWN " * 60, "a b c a b c d e f a b c " * 2, "\n".join(["same line here"] * 9 + [words(rnd, 50)])]
    got = {r.doc_id: r for r in quality.assess(docs(spark, texts, True)).collect()}
    for i, t in enumerate(texts):
        want = plain_quality(t)
        have = (got[i].n_words, got[i].word_chars, got[i].n_symbols, got[i].n_dup_lines, got[i].n_repeat_words)
        assert have[:4] == want[:4] and want[4] in (None, have[4]), (i, have, want)
        assert got[i].base_failed == (have[0] < 50 or 100 * have[4] > 50 * have[0])
    assert got[len(EDGE)].kept and not any(got[i].kept for i in range(len(EDGE)))
    kept = {r.doc_id for r in quality.keep(docs(spark, texts, True)).collect()}
    assert kept == {i for i in got if got[i].kept}
    assert quality.assess(docs(spark, texts).limit(0)).count() == 0


# --- 10

def plain_lines(rows):
    first = {}
    key = lambda x: re.sub("[A-Z]", lambda m: m.group().lower(), x.strip(" \t\n\x0b\x0c\r"))
    for i, t in rows:
        for x in (t or "").split("\n"):
            first.setdefault(key(x), set()).add(i)
    out = {}
    for i, t in rows:
        lines = (t or "").split("\n")
        keep = [x for x in lines if len(key(x)) < 10 or min(first[key(x)]) == i]
        out[i] = (len(lines), len(lines) - len(keep), hashlib.sha256("\n".join(keep).encode()).hexdigest())
    return out


def test_line_dedup(spark):
    rnd = random.Random(2)
    pool = [words(rnd, 4) for _ in range(12)] + ["short", "É la ligne COMMUNE", "é la ligne commune"]
    texts = EDGE + ["\n".join(rnd.choice(["", " ", "\t"]) + rnd.choice(pool) + rnd.choice(["", " "]) for _ in range(rnd.randrange(1, 90))) for _ in range(25)] + ["\n" * 300 + "the last line of all\nthe last line of all"]
    got = {r.doc_id: (r.n_lines, r.n_dropped, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in linededup.dedup_lines(docs(spark, texts, True)).collect()}
    assert got == plain_lines(list(enumerate(texts)))
    assert linededup.dedup_lines(docs(spark, texts).limit(0)).count() == 0


def test_line_dedup_null_ids_and_repeated_rows(spark):
    rows = spark.createDataFrame([(1, "a common line here\nmine alone only"), (1, "a common line here\nmine alone only"), (None, "a common line here"), (2, "a common line here")], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_dropped) for r in linededup.dedup_lines(rows).collect())
    assert got == [("1", 0), ("1", 0), ("2", 1), ("None", 1)]


# --- 9

def plain_overlap(rows, items, k=10):
    split = lambda t: [w.decode() for w in decontam.words_of(t)]
    windows = []
    for name, t in items:
        w = split(t)
        windows += [(name, w[i : i + k]) for i in range(max(len(w) - k, 0) + 1)] if w else []
    out = {}
    for i, t in rows:
        w, hit, found = split(t), set(), set()
        for name, g in windows:
            for p in range(len(w) - len(g) + 1):
                if w[p : p + len(g)] == g:
                    hit |= set(range(p, p + len(g)))
                    found.add(name)
        out[i] = (len(w), len(hit), sorted(found))
    return out


def test_decontamination(spark):
    rnd = random.Random(3)
    items = [("q10", words(rnd, 25, 60)), ("q2", words(rnd, 4, 60)), ("q3", None), ("q4", "..."), ("q2", words(rnd, 12, 60)), ("q5", "Éa " * 11)]
    texts = EDGE + [words(rnd, 30, 60) + " " + items[0][1].upper()[:150] + " " + words(rnd, 5, 60) for _ in range(5)] + [items[1][1] + " " + items[4][1], "éa " * 30, "Éa, " * 30, words(rnd, 900, 60)]
    bench = spark.createDataFrame(items, "item_id string, text string")
    for limit in (decontam.BLOCK_WINDOWS, 5):
        found = decontam.find_overlap(docs(spark, texts, True), bench, block_windows=limit).withColumn("hit", decontam.hit_words())
        got = {r.doc_id: (r.n_words, r.hit, list(r["items"])) for r in found.collect()}
        assert got == plain_overlap(list(enumerate(texts)), items)
    assert decontam.find_overlap(docs(spark, texts), bench.limit(0)).filter(F.size("items") > 0).count() == 0
    assert decontam.find_overlap(docs(spark, texts).limit(0), bench).count() == 0


def test_proximity(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    bench = spark.createDataFrame([("q", item)], "item_id string, text string")
    near = decontam.find_overlap(docs(spark, [item.replace("gamma", "gamma so"), item, "alpha x beta y"]), bench).orderBy("doc_id").collect()
    assert [list(r["near_items"]) for r in near] == [["q"], ["q"], []] and [len(r["items"]) for r in near] == [0, 1, 0]


def test_proximity_does_not_depend_on_other_documents(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    rnd = random.Random(14)
    other = words(rnd, 40, 60)
    bench = spark.createDataFrame([("q", item), ("r", other)], "item_id string, text string")
    texts = [words(rnd, 30) + " " + item.replace(w, "other") + " " + words(rnd, 30) for w in item.split()] + [words(rnd, 60) for _ in range(5)]

    def near(rows, parts, limit=decontam.BLOCK_WINDOWS):
        found = decontam.find_overlap(docs(spark, rows).repartition(parts), bench, block_windows=limit).collect()
        return [list(r["near_items"]) for r in sorted(found, key=lambda r: r.doc_id)][: len(texts)]

    alone = [near([t], 1)[0] for t in texts[:2]]
    together = near(texts, 1)
    assert alone == together[:2] and all("q" in n for n in together[:10]) and not any("q" in n for n in together[10:])
    assert together == near(texts + [item, other], 1) == near(texts + [item, other], 5) == near(texts + [item], 1, 5)


def test_proximity_at_the_head_of_a_document():
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    block = decontam.Block([("q", [decontam.signed(w.encode()) for w in item.split()], [1] * 10)])
    for cut in (1, 2):
        head = " ".join(item.split()[cut:]) + " and more"
        shard = decontam.Shard.of_texts(["clean words " * 9, head, "other clean words", head], None, decontam.WINDOW + decontam.SLACK)
        assert [(d, near) for d, _, _, near in decontam.search(shard, block)] == [(1, ["q"]), (3, ["q"])]


def test_stored_shards():
    rnd = random.Random(15)
    texts = [words(rnd, n, 50) for n in (0, 1, 40, 300)] + [None]
    shard = decontam.Shard.of_texts(texts, None, 13)
    again = decontam.Shard.unpacked(shard.packed(), 13)
    for name in ("terms", "lengths", "places", "counts", "starts"):
        assert (getattr(shard, name) == getattr(again, name)).all()
    for term, a, n in zip(shard.terms.tolist(), shard.begin.tolist(), shard.lengths.tolist()):
        want = [shard.starts[d] + i for d, t in enumerate(texts) for i, w in enumerate(decontam.words_of(t)) if decontam.signed(w) == term]
        assert shard.places[a : a + n].tolist() == want


def test_terms_are_the_built_in_hash(spark):
    names = ["a", "abcdefgh" * 5, "é", "x1"]
    got = spark.createDataFrame([(w,) for w in names], "w string").select("w", F.xxhash64("w").alias("h")).collect()
    assert all(r.h == decontam.signed(r.w.encode()) for r in got)


def test_toxicity_trains_on_one_text_an_id(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "train", lambda bags, marks: seen.append((len(bags), marks.sum())) or toxicity.Model(toxicity.np.zeros(toxicity.BUCKETS), 0.0))
    rows = [(i, f"text of {i}") for i in range(40)] + [(1, f"other text {i}") for i in range(300)] + [(1, None)]
    labels = [(i, i % 2) for i in range(40)]
    rows, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    toxicity.fit(rows, labels)
    usable = labels.filter(~toxicity.held_out())
    assert usable.filter("doc_id = 1").count() == 1
    assert seen == [(usable.count(), usable.filter("toxic = 1").count())]


def test_html_marked_wrappers():
    prose = "".join(f"<p>Sentence {i} of the article tells a long story, with commas, about a place.</p>" for i in range(8))
    side = "<div class='sidebar'>Short notes beside it</div><div class='ad'>Buy this now</div>"
    for name in ("content-with-sidebar", "layout-sidebar", "ad-free", "search-results"):
        for inner in (f"<div>{prose}</div>", f"<article>{prose}</article>"):
            got = htmltext.extract(f"<html><body><div class='{name}'>{inner}{side}</div></body></html>")
            assert got.count("Sentence") == 8 and "Short notes" not in got and "Buy this" not in got
    got = htmltext.extract(f"<html><body><article>{prose}</article><div class='comments'><article>{'<p>A comment.</p>' * 3}</article></div></body></html>")
    assert got.count("Sentence") == 8 and "comment" not in got


# --- 3

def test_mixing(spark):
    rnd = random.Random(4)
    texts = [None, "", "  "] + [words(rnd, rnd.randrange(1, 40)) for _ in range(600)]
    df = docs(spark, texts, True, ["s1", None, "s2", "s10", "s2", "s2"])
    got = mixing.mix(df, budgets=(1.0, 0.5)).collect()
    sizes, taken = {}, {}
    for r in got:
        assert r.size == len((r.text or "").split()) and r.taken % max(r.size, 1) == 0 and r.taken <= 3 * r.size
        assert r.taken_1 <= r.taken or r.size == 0  # nested
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    goal = mixing.targets(sizes)
    assert sorted(goal, key=lambda s: (s is None, s)) == ["s1", "s10", "s2", None]
    assert sum(goal.values()) == pytest.approx(sum(sizes.values()))
    for r in got:
        assert r.target == pytest.approx(goal[r.source]) and r.source_size == sizes[r.source]
    for s in sizes:
        assert abs(taken[s] - goal[s]) <= 40 and goal[s] <= 3 * sizes[s] + 1e-6
    again = {(r.doc_id, r.taken) for r in mixing.mix(df.repartition(7), budgets=(1.0, 0.5)).collect()}
    assert again == {(r.doc_id, r.taken) for r in got}
    assert mixing.mix(df.limit(0)).count() == 0


def test_targets_reshare():
    assert mixing.targets({"a": 10, "b": 1000, "c": 1000}) == {"a": 30.0, "b": pytest.approx(1980 * 2 / 3), "c": pytest.approx(1980 / 3)}
    assert mixing.targets({"a": 0, "b": 6}) == {"a": 0.0, "b": 6.0}


# --- 7

def test_pii(spark):
    texts = EDGE + [
        "a@b.c_d@e.f x", "1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.4", "+1 (234) 567-8901.", "4111 1111-1111 1111é 4111111111111111", "+1+2+34567890123 x@y.z.",
        "a.b@c..d e@f.g-h.i", "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6", "9" * 20000, "a" * 3000 + "@x", "+1" + " " * 1000, "99999999999999999999.1.1.1",
    ]
    df = docs(spark, texts, True)
    df.write.mode("overwrite").parquet(at := "/tmp/finloom-test-pii/documents.parquet")
    got = {r.doc_id: ([r.n_email, r.n_ip, r.n_card, r.n_phone], r.base_sha256) for r in registry.op7_pii(spark, at.rsplit("/", 1)[0]).collect()}
    assert got == {i: brute.pii(t)[:2] for i, t in enumerate(texts)}
    assert pii.find_pii(df.limit(0)).count() == 0


def test_pii_further_kinds(spark):
    texts = ["iban DE89 3704 0044 0532 0130 00 end", "DE88 3704 0044 0532 0130 00", "my ssn 123-45-6789", "part 123-45-6789", 'token = "65f8700754a1d8161928a1d0cca87ca77d009e4f"', "65f8700754a1d8161928a1d0cca87ca77d009e4f token"]
    got = {r.doc_id: [s["kind"] for s in r.pii] for r in pii.find_pii(docs(spark, texts)).collect()}
    assert [[k for k in got[i] if k not in ("card", "phone")] for i in range(6)] == [["iban"], [], ["ssn"], [], ["secret"], []]
    masked = pii.mask_pii(pii.find_pii(docs(spark, ["x a@b.c y 1.2.3.4."]))).first().text
    assert masked == "x [EMAIL] y [IP]."


def test_pii_context_over_matches(spark):
    key = "65f8700754a1d8161928a1d0cca87ca77d009e4f"
    texts = [
        "SSN: 123-45-6789, 234-56-7890, 345-67-8901", "é" * 50 + " ssn 000-45-6789 234-56-7890", "ssn " + "." * 40 + "123-45-6789", f"github_personal_access_token = {key}",
        f"{'x' * 60}_token: {key}", f"token={key}", f"api_key={key}&x=1", f"other={key} token",
    ]
    found = pii.find_pii(docs(spark, texts)).orderBy("doc_id").collect()
    got = [[r.text[s["start"] : s["end"]] for s in r.pii if s["kind"] in ("ssn", "secret")] for r in found]
    assert got == [["123-45-6789", "234-56-7890", "345-67-8901"], ["234-56-7890"], []] + [[key]] * 4 + [[]]
    masked = pii.mask_pii(pii.find_pii(docs(spark, [texts[5], texts[0]]))).orderBy("doc_id").collect()
    assert [r.text for r in masked] == ["token=[SECRET]", "SSN: [SSN], [SSN], [SSN]"]


def test_pii_all_spans(spark):
    """Generated texts against the row-by-row version, spans of all kinds."""
    rnd = random.Random(31)
    bits = ["123-45-6789", "321-54-9876", "666-12-1234", "ssn", "SSN:", "is my social security number", "token=", "api_key: ", "secret ", "65f8700754a1b2c3d4e5f6", "abcdefghijklmnopqrstuvwxyz", "GB82 WEST 1234 5698 7654 32", "GB82 WEST 1234 5698 7654 33", "a.b@c.de", "10.0.0.1", "999.1.1.1",
            "4111 1111 1111 1111", "+49 170 1234567", "é" * 9, "word " * 7, "\n", "x" * 45, ",", "=", "password is "]
    texts = ["".join(rnd.choice(bits) + rnd.choice([" ", ", ", ""]) for _ in range(rnd.randrange(1, 14))) for _ in range(300)]
    texts += ["321-54-9876 is my social security number", "my ssn 123-45-6789 and 321-54-9876", "token=65f8700754a1b2c3d4e5", None, ""]
    got = pii.find_pii(docs(spark, texts)).select("doc_id", registry._listed(F.col("pii")).alias("spans")).collect()
    for r in got:
        assert r.spans == brute.all_spans(texts[r.doc_id]), texts[r.doc_id]
    found = {r.doc_id: r.spans for r in got}
    assert found[300] == "ssn:0:11" and found[301].count("ssn") == 2 and "secret" in found[302]


# --- 2

def test_licenses(spark):
    rnd = random.Random(5)
    long = licenses.TEMPLATES[4][1]
    cut = long.split()
    changed = " ".join(w if i % 40 else "other" for i, w in enumerate(cut))
    texts = EDGE + [words(rnd, 300) + " Released under the MIT License. " + words(rnd, 50), words(rnd, 90) + " " + long + " " + words(rnd, 33), "x " + changed, "released under the license of mit", "LICENSED UNDER\nthe Apache License Version 2.0"]
    got = sorted((r.doc_id, r.template) for r in licenses.scan(docs(spark, texts, True)).collect())
    n = len(EDGE)
    assert got == [(n, 2), (n + 1, 4), (n + 2, 4), (n + 4, 0)]
    with pytest.raises(ValueError):
        licenses.scan(docs(spark, texts), [("X", "too short")])
    assert licenses.scan(docs(spark, texts).limit(0)).count() == 0


def test_licenses_with_a_large_index(spark, monkeypatch):
    """Beyond the literals the index is joined as a table, with the same result."""
    texts = EDGE + ["so " + t for _, t in licenses.TEMPLATES]
    find = lambda: sorted((r.doc_id, r.template, r.n_shared) for r in licenses.scan(docs(spark, texts)).collect())
    few = find()
    monkeypatch.setattr(licenses, "MAX_KEYS", 5)
    assert find() == few and {t for _, t, _ in few} == set(range(len(licenses.TEMPLATES)))


# --- 1

def test_toxicity(spark):
    rnd = random.Random(6)
    bad = ["worthless", "pathetic", "disgusting"]
    def text(toxic):
        w = words(rnd, 40).split()
        for _ in range(3 * toxic):
            w[rnd.randrange(40)] = rnd.choice(bad)
        return " ".join(w)

    marks = [i % 4 == 0 for i in range(400)]
    texts = [text(m) for m in marks] + ["so worthles and patheticc you disgustng w1 w2 w3 w4", None, "", "w5 " * 200_000]
    df = docs(spark, texts, True)
    labels = spark.createDataFrame([(i, int(m)) for i, m in enumerate(marks)] + [(None, 1), (0, None)], "doc_id long, toxic int")
    model = toxicity.fit(df, labels)
    got = {r.doc_id: r for r in toxicity.score(df, model).withColumn("out", toxicity.held_out()).collect()}
    held = [i for i in range(400) if got[i].out]
    assert 40 < len(held) < 130
    assert sum((got[i].score >= 0.5) == marks[i] for i in held) >= 0.95 * len(held)
    assert got[400].score >= 0.5 and got[401].score == got[402].score < 0.5 and got[403].predicted == 0
    none = toxicity.fit(df, labels.limit(0))
    assert none.score("x") < 1e-6


def test_score_is_the_softmax_of_the_mean_embedding():
    """The folded score against n-grams cut one by one, their embeddings averaged, and the softmax as trained."""
    np = toxicity.np

    def gram(text):
        h = 0
        for c in text:
            h = (h ^ ord(c)) * 0x9E3779B1 % 2**32
            h ^= h >> 15
        return (h * 0x85EBCA6B % 2**32 >> 16) % toxicity.BUCKETS

    def plain(text, parts):
        E, W, b = parts
        line = " " + re.sub(r"[\W_]+", " ", text.lower()).strip() + " "
        grams = [gram(line[i : i + n]) for n in toxicity.LENGTHS for i in range(len(line) - n + 1) if " " not in line[i + 1 : i + n - 1]]
        z = (E[grams].astype(float).mean(0) if grams else np.zeros(E.shape[1])) @ W + b
        return float(np.exp(z[1]) / np.exp(z).sum())

    rnd = random.Random(18)
    texts = [words(rnd, 30) + (" nasty" if i % 3 == 0 else " kind") for i in range(90)]
    model = toxicity.train([toxicity.bag(t) for t in texts], np.array([i % 3 == 0 for i in range(90)], np.int64))
    for t in texts[:20] + ["nastyy w1", "Ünï_code 漢字", "a", "", "..."]:
        assert model.score(t) == pytest.approx(plain(t, model.parts), abs=1e-5), t


def test_bag_pieces(monkeypatch):
    text = "some words ähnlich to these " * 40
    whole = toxicity.bag(text)
    monkeypatch.setattr(toxicity, "PIECE", 37)
    parts = toxicity.bag(text)
    assert (whole[0] == parts[0]).all() and abs(whole[1] - parts[1]).max() < 1e-6


# --- 4

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href=1>Home</a><li><a href=2>More</a></ul></nav>
<div class="cookie-notice">We use cookies, please accept all of them now.</div><header>Site name</header><div id=wrap><article><header><h1>A &amp; B</h1></header>
<p>First <b>para</b> of   text.<br>More.<p>Second&nbsp;para &lt;x&gt;<script>var a="</p>";</script></article><div class="comments"><p>I like this very much indeed, what a text</p></div></div>
<aside>side</aside><form><p>Subscribe</p></form><footer>&copy; me</footer>"""


def test_html(spark):
    pages = [(0, "u", PAGE), (1, None, None), (2, "u", ""), (3, "u", "plain &amp; simple"), (4, "u", "<div" * 3), (5, "u", "<b>" * 4000 + "deep"), (6, "u", "<nav>only</nav>")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = {r.page_id: (r.text, r.n_chars) for r in htmltext.extract_pages(df).collect()}
    assert got[0][0] == "A & B\nFirst para of text. More.\nSecond para <x>"
    assert [got[i][0] for i in (1, 2, 3, 5, 6)] == ["", "", "plain & simple", "deep", ""] and got[1][1] == 0
    assert htmltext.extract_pages(df.limit(0)).count() == 0


SENTENCE = "This is a sentence of running text that says something in plain words. "


def test_html_density(monkeypatch):
    """Pages that only density can tell apart: no article, no marks. Without the measure they fail."""
    prose = SENTENCE * 4
    menu = "<div class=x1><a href=1>one</a> <a href=2>two</a> <a href=3>three</a></div>"
    page = f"<body>{menu}<div class=x2>" + f"<p>{prose}</p>" * 4 + "</div><div class=x3><a href=9>next page of the site</a></div></body>"
    want = "\n".join([prose.strip()] * 4)
    assert htmltext.extract(page) == want
    beside = f"<body>{menu}" + f"<p>{prose}</p>" * 4 + "</body>"  # the body itself is the core
    assert htmltext.extract(beside) == want
    teaser = f"<body><article><p><a href=1>Another story</a></p></article><div><div><p>{prose}</p><p>{prose}</p><p>{prose}</p><p>{prose}</p></div></div></body>"
    assert htmltext.extract(teaser) == want
    table = "<div>" + "".join(f"<div>w{i}</div>" for i in range(12)) + "</div>"  # many tags, little text, no link
    thin = f"<body>{table}<div>" + f"<p>{prose}</p>" * 4 + "</div></body>"
    assert htmltext.extract(thin) == want
    monkeypatch.setattr(htmltext, "density", lambda *_: 1.0)
    assert htmltext.extract(thin) != want


def test_html_article_keeps_its_parts():
    inner = '<h1>Title</h1><p>Lead paragraph.</p></header><p>Body of it.</p><table class="related-party"><tr><td>cell</td></tr></table><p class="notice-period">30 days</p><div id="search-methods">We searched.</div>'
    menu = "<ul><li><a href=1>a</a><li><a href=2>b</a></ul>"
    got = htmltext.extract(f'<body><header>Site</header><article><header>{menu}{inner}<div class="ad">Buy this</div><div class="comment-list"><p>{SENTENCE * 9}</p></div></article></body>')
    assert got.split("\n") == ["Title", "Lead paragraph.", "Body of it.", "cell", "30 days", "We searched."]


def test_html_generated_pages():
    """Against the blocks that a generator of pages knows to be the text."""
    rnd = random.Random(21)
    sentence = lambda n: " ".join(words(rnd, 8, 900).capitalize() + "." for _ in range(n))
    for turn in range(120):
        blocks, body = [], []
        for _ in range(rnd.randrange(3, 9)):
            kind = rnd.randrange(4)
            t = sentence(rnd.randrange(2, 6))
            if kind == 0:
                a, b, c = t.split(" ", 2)
                blocks.append(t)
                body.append(f"<p>{a} <a href='/x'>{b}</a>  {c}")
            elif kind == 1:
                parts = [sentence(2) for _ in range(3)]
                blocks += parts
                body.append("<ul>" + "".join(f"<li>{x}" for x in parts) + "</ul>")
            elif kind == 2:
                blocks.append(t + " & more")
                body.append(f"<blockquote>{t} &amp;\n\tmore</blockquote>")
            else:
                blocks.append(t)
                body.append(f"<p>{t}</p>")
        title = sentence(1)
        around = rnd.choice(["<article>{}</article>", "<main>{}</main>", "<div>{}</div>", "<div id=content-with-sidebar><div>{}</div></div>", "<section class=post>{}</section>"])
        links = "".join(f"<a href=/{i}>{words(rnd, 1)}</a> " for i in range(rnd.randrange(4, 9)))
        before = rnd.choice(["", f"<nav>{links}</nav>", f"<div>{links}</div>", f"<ul><li>{links}</ul>", "<header>Site <b>name</b></header>"])
        after = rnd.choice(["", "<footer>&copy; me</footer>", f"<aside><p>{sentence(1)}</p></aside>", f"<div class=sidebar>{links}</div>", f"<div class=comments><p>{sentence(2)}</p></div>", "<form><p>Subscribe now</p></form>"])
        page = f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style></head><body>{before}{around.format(f'<h1>{title}</h1>' + ''.join(body))}<script>var a='<p>';</script>{after}</body></html>"
        assert htmltext.extract(page).split("\n") == [title, *blocks], (turn, page)


def test_html_broken_markup_is_linear():
    import time

    for bad in ("<a" * 200_000, "if a<b then " * 40_000, '<a ">" ' * 40_000, "<ul>" + "<span>" * 5000 + "<li>x" * 20_000, "<b><div>" + "<i>" * 5000 + "</b>" * 40_000, "<!--" * 100_000, "<a '" * 50_000 + '">' * 3):
        began = time.process_time()
        htmltext.extract(bad)
        assert time.process_time() - began < 3
    assert htmltext.extract("if a<b then") == "if a<b then" and htmltext.extract("<p>one<p>two <b unclosed") == "one\ntwo <b unclosed"


# --- 5

def test_suffixes(spark):
    rnd = random.Random(7)
    base = "".join(rnd.choice("abcd ") for _ in range(400))
    texts = EDGE[:6] + ["a" * 400, "a" * 60]
    for _ in range(30):
        t = "".join(rnd.choice("abcd ") for _ in range(rnd.randrange(150)))
        for _ in range(rnd.randrange(3)):
            at = rnd.randrange(350)
            t += base[at : at + rnd.randrange(30, 140)] + rnd.choice(["", "é"])
        texts.append(t)
    rows = list(enumerate(texts))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.find_repeats(docs(spark, texts, True).repartition(5)).collect()}
    assert got == brute.repeats(rows)
    assert suffixes.find_repeats(docs(spark, texts).limit(0)).count() == 0


def test_suffixes_ids(spark):
    t = "the same passage of more than fifty bytes stands in all of these rows"
    rows = spark.createDataFrame([(1, t), (1, t), (1, "x" + t), (None, t), (2, t + "y")], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_removed) for r in suffixes.find_repeats(rows).collect())
    assert got == [("1", 0), ("1", 0), ("1", 0), ("2", len(t)), ("None", len(t))]


def test_suffixes_many_texts_of_an_id(spark):
    rnd = random.Random(13)
    passage = "".join(rnd.choice("abcdefgh ") for _ in range(70))
    own = lambda i: f"{i}-" + "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(90))
    texts = [own(i)[: 20 + i % 70] + (passage if i % 2 else "") + own(i)[:80] for i in range(4000)]
    for shared in (None, 5):
        rows = [(1, passage)] + [(shared, t) for t in texts]
        found = suffixes.find_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
        got = sorted(r.kept_sha256 for r in found.filter("n_bytes > 70").select("n_bytes", "kept_sha256").collect())
        assert got == sorted(hashlib.sha256(t.replace(passage, "").encode()).hexdigest() for t in texts)
        assert found.filter("n_removed not in (0, 70)").isEmpty()


def test_suffixes_many_rounds(spark, monkeypatch):
    """Three rounds of exchange give what one gives."""
    monkeypatch.setattr(suffixes, "FAN", 3)
    rnd = random.Random(22)
    base = [words(rnd, 40, 30) for _ in range(6)]
    texts = [" ".join([words(rnd, 9, 50), rnd.choice(base), words(rnd, 9, 50)]) for _ in range(40)] + [None, base[0]]
    assert suffixes.widths(20) == [9, 3, 1]
    got = {r.doc_id: tuple(r)[1:5] for r in suffixes.find_repeats(docs(spark, texts), range_bytes=1000).collect()}
    assert got == brute.repeats(list(enumerate(texts)))


def test_runs_stay_long_at_any_number_of_ranges():
    rnd = random.Random(23)
    data = " ".join(words(rnd, 100, 20_000) for _ in range(1500)).encode()
    edges = suffixes.np.arange(0, len(data) + 1, len(data) // 50)
    sizes = []
    for ranges in (128, 7_500, 250_000, 25_000_000):
        runs = list(suffixes.sorted_runs(data, edges[:-1], edges[1:], edges[:-1], edges[:-1] * 0, ranges, suffixes.widths(ranges)[0]))
        assert len(runs) <= suffixes.FAN
        finer = [x for _, run in runs[:8] for x in suffixes.merged_runs([run], ranges, suffixes.widths(ranges)[min(1, len(suffixes.widths(ranges)) - 1)])]
        assert finer
        sizes.append(sum(len(r) for _, r in runs))
    assert max(sizes) <= 1.3 * min(sizes)


def test_loser_tree():
    rnd = random.Random(8)
    for _ in range(50):
        runs = []
        for _ in range(rnd.randrange(1, 6)):
            s = sorted(bytes(rnd.choice(b"ab") for _ in range(suffixes.SPAN - 44)) + bytes(44) for _ in range(rnd.randrange(0, 9)))
            lcp = [0] + [next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), suffixes.SPAN) for a, b in zip(s, s[1:])]
            runs.append((s, lcp[: len(s)]))
        order, prefix = suffixes.loser_tree(runs)
        at, out = [0] * len(runs), []
        for r in order:
            out.append(runs[r][0][at[r]])
            at[r] += 1
        assert out == sorted(x for r in runs for x in r[0])
        want = [next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), suffixes.SPAN) for a, b in zip(out, out[1:])]
        assert prefix[1:] == want


# --- 6

def near_texts(rnd):
    texts = EDGE[:7]
    for _ in range(8):
        base = words(rnd, 60, 5000).split()
        for _ in range(rnd.randrange(1, 6)):
            copy = list(base)
            for _ in range(rnd.randrange(0, 3)):
                copy[rnd.randrange(60)] = f"w{rnd.randrange(5000)}"
            texts.append(" ".join(copy))
    return texts + [texts[-1], words(rnd, 3), "two words"]


def test_near_duplicates(spark):
    texts = near_texts(random.Random(9))
    got = {r.doc_id: r.class_id for r in neardup.classes(docs(spark, texts, True)).collect()}
    rows = list(enumerate(texts))
    want = brute.classes(rows)
    for i, t in rows:  # identical texts are one class, empty ones too
        want[i] = min(want[i], min(want[j] for j, u in rows if (u or "") == (t or "")))
    assert got == want
    kept = sorted(r.doc_id for r in neardup.keep_first(docs(spark, texts, True)).collect())
    assert kept == sorted(set(want.values()))
    assert neardup.classes(docs(spark, texts).limit(0)).count() == 0


def test_near_duplicate_tiles(spark, monkeypatch):
    """A crowded group whose members link only here and there, all through tiles."""
    monkeypatch.setattr(neardup, "FEW", 0)
    monkeypatch.setattr(neardup, "TILE", 8)
    rnd = random.Random(10)
    base = words(rnd, 80, 5000).split()
    texts = []
    for _ in range(60):
        copy = list(base)
        for _ in range(rnd.randrange(1, 5)):
            copy[rnd.randrange(80)] = f"x{rnd.randrange(5000)}"
        texts.append(" ".join(copy))
    got = {r.doc_id: r.class_id for r in neardup.classes(docs(spark, texts)).collect()}
    assert got == brute.classes(list(enumerate(texts)))


def test_near_duplicates_repeated_shingles():
    rnd = random.Random(12)
    for repeats in (20, 60, 200, 1000):
        texts = []
        for _ in range(15):
            base = words(rnd, 130, 10**6)
            texts += [base, base + (" " + words(rnd, 22, 10**6)) * repeats]
        assert all(neardup.similarity(neardup.shingles(a), neardup.shingles(b)) >= 0.8 for a, b in zip(texts[::2], texts[1::2]))
        bands, _ = neardup.sketch(texts)
        assert (bands[::2] == bands[1::2]).any(1).all()


def strata(rnd, pairs):
    """Pairs of texts at 0.80 to 0.86: short, long, with a repeated phrase in one of them."""
    out = {}
    for name, n, extra, repeat in (("short", 60, 12, 1), ("long", 1500, 300, 1), ("repeated phrase", 130, 18, 200), ("near 0.85", 400, 60, 1)):
        out[name] = []
        while len(out[name]) < pairs:
            a = words(rnd, n, 10**6)
            b = a + (" " + words(rnd, extra, 10**6)) * repeat
            if 0.80 <= neardup.similarity(neardup.shingles(a), neardup.shingles(b)) <= 0.87:
                out[name].append((a, b))
    return out


def test_near_duplicate_recall_by_strata():
    for name, pairs in strata(random.Random(16), 60).items():
        bands, _ = neardup.sketch([t for p in pairs for t in p])
        assert (bands[::2] == bands[1::2]).any(1).mean() >= 0.98, name


def test_near_duplicate_hubs(spark, monkeypatch):
    """A text with very many near copies, rows of hot keys spread."""
    monkeypatch.setattr(neardup, "HUB", 4)
    rnd = random.Random(17)
    base = words(rnd, 90, 10**6)
    texts = [base] + [base + f" tail{i}" for i in range(60)] + [base] * 30 + [words(rnd, 40, 10**6) for _ in range(5)]
    got = {r.doc_id: r.class_id for r in neardup.classes(docs(spark, texts)).collect()}
    assert got == brute.classes(list(enumerate(texts)))


def test_prob_minhash_estimates():
    import numpy as np

    rnd = np.random.default_rng(1)
    a, b = rnd.integers(1, 2**60, 300, dtype=np.uint64), rnd.integers(1, 2**60, 300, dtype=np.uint64)
    b[:200] = a[:200]
    out = neardup.prob_minhash(np.repeat([0, 1], 300), np.concatenate([a, b]), np.ones(600), 2, 2000)
    assert abs((out[0] == out[1]).mean() - 200 / 400) < 0.05


# --- queries, pipeline

def test_pipeline(spark):
    import corpus_pipeline

    rnd = random.Random(11)
    clean = [words(rnd, 80, 3000) for _ in range(12)]
    leak = clean[3] + " " + "one two three four five six seven eight nine ten"
    texts = clean + [clean[0], clean[1] + " extra", leak, "short", "# $ % " * 80, clean[5] + "\n" + "a line that stands twice"] + ["a line that stands twice\n" + words(rnd, 70, 3000)]
    at = "/tmp/finloom-test-pipeline"
    docs(spark, texts, sources=["a", "b"]).write.mode("overwrite").parquet(f"{at}/documents.parquet")
    spark.createDataFrame([("q", "One two three four five six seven eight nine ten.")], "item_id string, text string").write.mode("overwrite").parquet(f"{at}/benchmark.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, at).collect()}
    # brute force, stage by stage
    left = [(i, t) for i, t in enumerate(texts) if (q := plain_quality(t))[0] >= 50 and 2 * q[4] <= q[0] and 10 * q[2] <= q[0] and t != t.upper()]
    first, lines = set(), []
    for i, t in left:
        keep = [x for x in t.split("\n") if len(x) < 10 or x.lower() not in first]
        first |= {x.lower() for x in t.split("\n")}
        lines.append((i, "\n".join(keep)))
    group = brute.classes(lines)
    same = {i: min(group[j] for j, u in lines if u == t) for i, t in lines}
    single = [(i, t) for i, t in lines if same[i] == i]
    bench = plain_overlap(single, [("q", "one two three four five six seven eight nine ten")])
    stay = {i: t for i, t in single if not bench[i][1]}
    sizes = {}
    for i, t in stay.items():
        s = "ab"[i % 2]
        sizes[s] = sizes.get(s, 0) + len(t.split())
    goal = mixing.targets(sizes)
    assert set(got) <= set(stay) and all(got[i].text == stay[i] for i in got)
    for s, n in sizes.items():
        assert abs(sum(r.taken for r in got.values() if r.source == s) - goal[s]) <= 82
        assert all(r.source_size == n and r.target == pytest.approx(goal[s]) for r in got.values() if r.source == s)


def test_pipeline_edges(spark):
    """Nulls in any column, empty and long texts, repeated rows, clashing columns, empty tables."""
    import corpus_pipeline

    rnd = random.Random(19)
    good = [words(rnd, 80, 4000) for _ in range(6)]
    rows = [(0, good[0], "en", "a", 1), (0, good[0], "en", "a", 1), (None, good[1], None, None, None), (None, good[2], "en", "b", 3), (4, None, "en", "a", 0), (5, "", None, None, None), (6, "\n".join([good[3]] * 2), "en", "a", 9), (7, words(rnd, 60_000, 50_000), "en", None, 5), (8, good[4], "en", "b", 1)]
    at = "/tmp/finloom-test-edges"
    clash = {"size": F.lit("x"), "n_words": F.lit("y"), "kept": F.lit(0), "items": F.lit(1), "__q_text": F.lit("not me"), "taken": F.lit("z")}
    spark.createDataFrame(rows, SCHEMA).withColumns(clash).write.mode("overwrite").parquet(f"{at}/documents.parquet")
    bench = spark.createDataFrame([("q", good[4][:120]), (None, None)], "item_id string, text string")
    bench.write.mode("overwrite").parquet(f"{at}/benchmark.parquet")
    done = corpus_pipeline.run(spark, at)
    assert done.columns == [*corpus_pipeline.COLUMNS, "size", "source_size", "target", "taken"]
    got = done.collect()
    assert {r.text for r in got} <= {good[0], good[1], good[2], "\n".join([good[3]] * 2), rows[7][1]} and len(got) == len({r.text for r in got})
    assert all(r.size == len(r.text.split()) and r.taken > 0 for r in got)
    spark.createDataFrame([], SCHEMA).write.mode("overwrite").parquet(f"{at}/documents.parquet")
    assert corpus_pipeline.run(spark, at).count() == 0
    spark.createDataFrame(rows[:3], SCHEMA).write.mode("overwrite").parquet(f"{at}/documents.parquet")
    bench.limit(0).write.mode("overwrite").parquet(f"{at}/benchmark.parquet")
    assert {r.text for r in corpus_pipeline.run(spark, at).collect()} <= {good[0], good[1]}
