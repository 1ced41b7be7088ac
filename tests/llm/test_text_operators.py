"""The text operators against brute force, exact round trips and held-out labels, with awkward rows."""

import hashlib
import random
import re
import time
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tiegraph.llm import common, decontaminate, fingerprint, html_extraction, huffman, jaccard_join, labelled, lm_scoring, packing, pii, quality, tokens, toxicity

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
AWKWARD = [
    (1, "Alpha beta gamma delta epsilon.", "s"), (2, None, "s"), (3, "", None), (4, "  \n ", "t"), (5, "one", "s"), (5, "one", "s"), (6, "Alpha beta gamma delta epsilon.", "s"),
    (7, "x" * 5000, "t"), (8, "word " * 3000, "s"), (9, "é à 日本語 <|endoftext|> it's\tok", "u"), (None, "no id here at all", "s"), (10, "a  b \n c", "s"),
]
SCHEMA = "doc_id long, text string, source string"


@pytest.fixture(scope="module")
def awkward(spark):
    """Awkward rows, with extra columns of names that operators use themselves."""
    df = spark.createDataFrame(AWKWARD, SCHEMA)
    return df.select("*", F.lit(1).alias("score"), F.lit("x").alias("n_tokens"), F.lit("y").alias("words"), F.lit("z").alias("component_id"))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def encoded(path, end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    return lambda text: np.array([*t.encode(text or "", add_special_tokens=False).ids, end], "<u4")


def test_chunk_encoder_equals_library():
    random.seed(3)
    parts = [" ", " ", "\n", "a", "Be", ".", ",", "'s", "É", "́", " ", "5", "日", "<|endoftext|>", "***", "\t", "word", "(x)"]
    texts = ["".join(random.choice(parts) for _ in range(random.randint(0, 30))) for _ in range(1500)]
    from tokenizers import Tokenizer

    for path in (WORD, BYTE):
        enc, t = tokens.ChunkEncoder(path), Tokenizer.from_file(path)
        for x, got in zip(texts, enc.encode(texts), strict=True):
            assert list(np.frombuffer(got, enc.dtype)) == t.encode(x, add_special_tokens=False).ids, x


def test_fingerprints(spark, awkward, empty):
    got = fingerprint.fingerprint_pairs(awkward, rows_per_bucket=3).collect()
    rows = sorted(((2**63 if i is None else i, t or "") for i, t, _ in AWKWARD))
    want = []
    for k, (i, t) in enumerate(rows):
        n, nxt = len(t), rows[(k + 1) % len(rows)][1]
        want.append((None if i == 2**63 else i, n, hashlib.sha256((t[: n - n // 2] + nxt[: n // 2]).encode()).hexdigest()))
    assert sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got), key=str) == sorted(want, key=str)
    by = {r["doc_id"]: r for r in got}
    assert by[1]["fingerprint"] == by[6]["fingerprint"] != by[5]["fingerprint"] and by[2]["near_edited"] == 1.0
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    assert fingerprint.fingerprint_pairs(empty).count() == 0


def test_fingerprint_locates_edits(spark):
    a, b = "one\ntwo\n\nthree\nfour", "one\n2\n\nthree\nfour"
    df = spark.createDataFrame([(a, b)], "a string, b string").select(fingerprint.fingerprint(F.col("a")).alias("x"), fingerprint.fingerprint(F.col("b")).alias("y"))
    r = df.select(fingerprint.differing(F.col("x"), F.col("y")).alias("d"), fingerprint.likeness(F.col("x"), F.col("y")).alias("l"), fingerprint.likeness(F.col("x"), F.col("x")).alias("s")).head()
    assert r["d"] == [1] and 0.5 < r["l"] < 1 and r["s"] == 1.0


def test_next_text_over_many_buckets(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.select("doc_id", "text").orderBy("doc_id").collect()
    got = {r["doc_id"]: r["next_text"] for r in fingerprint.with_next_text(docs, 7).collect()}
    assert all(got[r["doc_id"]] == rows[(k + 1) % len(rows)]["text"] for k, r in enumerate(rows))


def test_leaks_found_exactly(spark, sf):
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    word = re.compile(r"[^\W_]+")
    bench = {r["item_id"]: word.findall(r["text"].lower()) for r in items.collect()}
    want = set()
    for r in docs.collect():
        w = " ".join(word.findall((r["text"] or "").lower()))
        want |= {(r["doc_id"], i) for i, x in bench.items() if f" {' '.join(x)} " in f" {w} "}
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, items).collect()}
    assert want and want <= got and len(got - want) <= 1
    kept = decontaminate.without_leaks(docs, items)
    assert kept.count() == docs.count() - len({d for d, _ in got}) and kept.columns == docs.columns


def test_near_leaks_and_awkward_rows(spark, awkward, empty):
    item = " ".join(f"w{k}" for k in range(60))
    near = item.replace("w3 ", "changed ")
    far = " ".join(f"w{k}" if k % 4 else "zzz" for k in range(60))
    docs = spark.createDataFrame([(1, f"before {near} after"), (2, f"before {far} after"), (3, None), (None, item), (4, "one two")], "doc_id long, text string")
    items = spark.createDataFrame([(7, item, 1), (7, item, 1), (8, None, 1), (9, "", 1), (10, "One, two!", 1), (None, item, 1)], "item_id long, text string, similarity int")
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontaminate.leaks(docs, items).collect()}
    assert set(got) == {(1, 7), (4, 10)} and 0.8 <= got[1, 7] < 1 and got[4, 10] == 1.0
    assert decontaminate.leaks(awkward, items.where("false")).count() == 0 and decontaminate.leaks(empty, items).count() == 0


def _weighted_jaccard(a, b):
    w = lambda s: sum(len(x) for x in s)
    return w(a & b) / w(a | b) if a | b else 0.0


def test_leaks_equal_brute_force_over_all_windows(spark):
    """Items with words changed, swapped halves and cut ends, in documents of words they share: every window is tried."""
    rng = random.Random(8)
    words = [f"w{k:02d}" for k in range(60)]
    items = [[rng.choice(words) + str(i) for _ in range(n)] for i, n in enumerate((12, 20, 20, 40, 3, 60))]
    docs = []
    for k in range(140):
        x = list(rng.choice(items))
        if k % 4 == 1 and len(x) > 10:
            x = x[len(x) // 2 :] + x[: len(x) // 2]
        for _ in range(k % 4):
            x[rng.randrange(len(x))] = rng.choice(words)
        x = x[: len(x) - k % 3] if k % 5 == 0 else x
        docs.append([rng.choice(words) for _ in range(k % 7 * 5)] + x + [rng.choice(words) for _ in range(k % 3 * 6)])
    shingles = lambda w, n: {" ".join(w[i : i + n]) for i in range(len(w) - n + 1)}
    want = {}
    for d, w in enumerate(docs):
        for i, x in enumerate(items):
            size = min(5, len(x))
            best = max(_weighted_jaccard(shingles(w[s : s + len(x)], size), shingles(x, size)) for s in range(len(w)))
            if best >= 0.8:
                want[d, i] = best
    df = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(docs)], "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontaminate.leaks(df, bench).collect()}
    assert set(got) <= set(want) and len(got) >= 0.99 * len(want) > 20
    assert all(got[k] == pytest.approx(want[k]) for k in got)


def test_simhash_blocks_find_all_within_radius():
    rng = random.Random(1)
    edges = np.cumsum([0, *decontaminate._WIDTHS])
    assert edges[-1] == decontaminate.BITS
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a
        for k in rng.sample(range(64), decontaminate.RADIUS):
            b ^= 1 << k
        x, y = f"{a:064b}", f"{b:064b}"
        assert any(x[s:e] == y[s:e] for s, e in zip(edges, edges[1:], strict=False))


def _components(rows, size, percent):
    """Brute force: all pairs."""
    sets = []
    for _, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set()))
    comp = list(range(len(rows)))

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                comp[max(root(i), root(j))] = min(root(i), root(j))
    least = defaultdict(list)
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root(i)].append(r[0])
    return sorted(((r[0], len(sets[i]), min(least[root(i)], default=None) if sets[i] else r[0]) for i, r in enumerate(rows)), key=str)


def test_jaccard_components_equal_brute_force(spark, awkward, empty):
    got = jaccard_join.linked_components(awkward, 4, 85)
    assert sorted(map(tuple, got.collect()), key=str) == _components(AWKWARD, 4, 85)
    rng = random.Random(5)
    base = [[f"t{rng.randint(0, 400)}" for _ in range(rng.randint(3, 90))] for _ in range(12)]
    rows = []
    for k in range(160):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
            w[rng.randrange(len(w))] = f"n{rng.randint(0, 50)}"
        rows.append((k, " ".join(w) + rng.choice(["", " tail words of many documents here"])))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = jaccard_join.linked_components(df, 4, 85)
    assert sorted(map(tuple, got.collect()), key=str) == _components(rows, 4, 85)
    assert jaccard_join.linked_components(empty, 4, 85).count() == 0


def test_keep_one(spark, awkward):
    kept = jaccard_join.keep_one(awkward)
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(x for x in ids if x is not None) == [1, 2, 3, 4, 5, 7, 8, 9, 10] and ids.count(None) == 1 and kept.columns == awkward.columns


def test_html(spark):
    page = (
        "<html><head><title>t</title></head><body><header><h1>Site</h1></header><nav><ul><li>menu</ul></nav><div id='cookie-notice'>We use cookies</div><main><article class='post'><h1>Title {n} &amp; more</h1><p>Text {n} <a href=x>two</a>&nbsp;"
        "three<p>Next {n} <b>x<br>y</b><div>Share this story</div><div class='comments'><p>bad comment</div><form>name<input></form><script>var t='</p>';</script><p>1 < 2 &#8364; {n}</article><aside>no</aside></main><footer>f</footer>"
    )
    rows = [(k, f"http://a.example/{k}", page.replace("{n}", str(k))) for k in range(6)] + [(10, "http://b.example/", "<p>alone"), (11, None, None), (12, "", ""), (13, "http://a.example/x", "<article><p>cut <b>off"), (13, "http://a.example/x", "<article><p>cut <b>off")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    out = html_extraction.extract(df).collect()
    got = {r["page_id"]: r["text"] for r in out}
    assert got[2] == "Title 2 & more\n\nText 2 two three\n\nNext 2 x y\n\n1 < 2 € 2"  # the constant line is template
    assert got[10] == "alone" and got[11] == "" == got[12] and got[13] == "cut off" and len(out) == len(rows)
    assert html_extraction.extract(df.where("false")).count() == 0


def _folded(page):
    return html_extraction.fold(html_extraction.parse(page)[0])


def test_tree_matching_prefers_the_larger_alignment():
    a, b = _folded("<div><p>x</p><ul><li>1</li></ul><p>y</p></div>"), _folded("<div><ul><li>1</li></ul><p>y</p></div>")
    assert html_extraction.tree_match(a, b)[0] == 5


def test_tree_matching_equals_brute_force():
    def size(a, b):
        if a.label != b.label:
            return 0

        def best(x, y):
            return max(best(x[1:], y), best(x, y[1:]), size(x[0], y[0]) + best(x[1:], y[1:])) if x and y else 0

        return 1 + best(a.children, b.children)

    rng = random.Random(4)

    def page(depth):
        return "".join(f"<{t}>{page(depth - 1) if depth else 'x'}</{t}>" for t in (rng.choice(["div", "ul", "section"]) for _ in range(rng.randint(0, 4))))

    for _ in range(40):
        a, b = _folded(page(3)), _folded(page(3))
        assert html_extraction.tree_match(a, b)[0] == size(a, b)
        assert html_extraction.outline(html_extraction.from_outline(html_extraction.outline(a))) == html_extraction.outline(a)


def _text(page):
    root, blocks = html_extraction.parse(page)
    return "\n\n".join(blocks[k][1] for k in html_extraction.scope(root, blocks))


def test_layout_names_and_odd_pages():
    assert _text('<div class="elementor-widget-container"><p>One.</p></div><div class="elementor-widget-container"><p>Two.</p></div>') == "One.\n\nTwo."
    assert _text('<div id="page" class="layout no-sidebar"><article><p>Text</p></article></div>') == "Text"
    assert _text('<div class="search-page"><p>All of it</p></div>') == "All of it"
    assert _text('<p>A long enough paragraph of text.</p><div class="cookie-notice">We use them</div><div id=comments><p>Nice</p></div>') == "A long enough paragraph of text."
    assert _text("<article><p>a <math><mi>x</mi></math> b <object>c</object></article>") == "a x b c"
    deep = "<div>" * 5000 + "<p>deep</p>" + "</div>" * 5000
    assert _text(deep) == "deep" and html_extraction.tree_match(_folded(deep), _folded(deep))[0] == 5002
    began = time.time()
    assert _text('<a "' * 250_000) is not None and _text("<p>x" + '<a "' * 250_000 + ">") is not None and _text("<p>a " * 50_000).count("a") == 50_000
    assert time.time() - began < 20


def test_copies_keep_their_text_and_short_articles_lose_boilerplate(spark):
    licence = "This text is under a licence that is a good deal longer than the article itself is. " * 3
    short = [(k, "http://s.example/", f"<div><h1>Head {k}</h1><p>News {k}</p></div><div><p>{licence}</p></div>") for k in range(5)]
    copies = [(k, "http://c.example/", "<div><h1>Same</h1><p>Same text</p></div>") for k in range(10, 15)]
    rare = [(k, "http://s.example/", f"<section><h2>Other {k}</h2><p>Word {k}</p><table><tr><td>Fixed cell</table></section>") for k in range(20, 24)]
    df = spark.createDataFrame(short + copies + rare, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_extraction.extract(df).collect()}
    assert got[3] == "Head 3\n\nNews 3" and got[12] == "Same\n\nSame text" and got[21] == "Other 21\n\nWord 21"


def _recall_precision(predicted, marked):
    hits = (predicted & marked).sum()
    return hits / marked.sum(), hits / max(predicted.sum(), 1)


def test_classifiers_on_held_out_rows(spark, awkward, empty):
    """On the rows that never train: far more than the majority class gives, on both sides."""
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    q = quality.score(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    recall, precision = _recall_precision(q["predicted"] == 0, q["quality"] == 0)
    assert recall > 0.6 and precision > 0.6, (recall, precision)
    t = toxicity.score(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    recall, precision = _recall_precision(t["predicted"] == 1, t["toxic"] == 1)
    assert recall > 0.6 and precision > 0.6, (recall, precision)
    for score in (quality.score, toxicity.score):
        out = score(awkward, labels).toPandas()
        assert len(out) == len(AWKWARD) and out["score"].between(0, 1).all()
        assert score(empty, labels).count() == 0
        assert score(awkward, labels.where("false")).count() == len(AWKWARD)
    kept = quality.keep(docs, labels)
    assert kept.columns == docs.columns and 0.8 < kept.count() / docs.count() < 0.95


def test_held_out_rows_never_train(spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    used = labelled.sample(spark.read.parquet(f"{sf}/documents.parquet"), labels, "quality", 1000).collect()
    assert used and all(zlib.crc32(str(r["doc_id"]).encode()) % 5 for r in used)


def test_language_model_scores_equal_brute_force(spark, awkward, empty):
    target = spark.createDataFrame([(1,), (8,)], "doc_id long")
    out = lm_scoring.score(awkward, target).collect()
    assert len(out) == len(AWKWARD)
    models = {}
    for name, keep in (("background", lambda i: True), ("target", lambda i: i in (1, 8))):
        words, pairs = np.zeros(1 << lm_scoring.VOCAB_BITS, np.float32), np.zeros(1 << lm_scoring.PAIR_BITS, np.float32)
        for i, t, _ in AWKWARD:
            if keep(i):
                one, two = lm_scoring.slots(t)
                np.add.at(words, one, 1)
                np.add.at(pairs, two, 1)
        models[name] = (words, pairs)
    texts = dict((i, t) for i, t, _ in AWKWARD)
    for r in out:
        a, b = (lm_scoring.losses(texts[r["doc_id"]], models[m]) for m in ("target", "background"))
        assert r["n_tokens"] == len(a)
        if len(a):
            assert r["score"] == pytest.approx(a.mean() - b.mean(), abs=1e-4)
        else:
            assert r["score"] == 0 and r["target_loss"] is None
    assert lm_scoring.score(empty, target).count() == 0


def test_language_model_counts_are_exact(spark):
    """So many words that tables of 2^18 slots would merge some; chunks and buckets that share words and pairs."""
    rng = random.Random(9)
    rows = [(k, " ".join(f"w{int(rng.paretovariate(0.12)) % 90000}" for _ in range(rng.randint(1, 150)))) for k in range(1500)]
    wanted = set(range(0, 1500, 3))
    models = {}
    for m in ("target", "background"):
        one, two = defaultdict(int), defaultdict(int)
        for k, t in rows:
            w = ["", *t.split()]
            for a, b in zip(w, w[1:], strict=False) if m == "background" or k in wanted else ():
                two[a, b] += 1
            for a in w if m == "background" or k in wanted else ():
                one[a] += 1
        models[m] = one, two, sum(one.values())
    room = max(len(models["background"][0]), 1 << lm_scoring.VOCAB_BITS)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    target = spark.createDataFrame([(k,) for k in wanted], "doc_id long")
    out = lm_scoring.score(df, target).collect()
    assert len(out) == len(rows)
    for r in out:
        w = ["", *rows[r["doc_id"]][1].split()]
        for m, (one, two, total) in models.items():
            p = [0.7 * (two.get((a, b), 0) / one[a] if one.get(a) else 0) + 0.3 * (one.get(b, 0) + 1) / (total + room) for a, b in zip(w, w[1:], strict=False)]
            assert r[f"{m}_loss"] == pytest.approx(-np.log(p).mean(), abs=1e-9)


def test_language_model_keys_leave_no_shuffle_files(spark):
    """They are most of the operator's disk; left to the driver's garbage collector they stay beside the next shuffle."""

    def shuffled():
        found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {f.getPath(): f.length() for f in (found.apply(k) for k in range(found.size())) if f.getName().startswith("shuffle_")}

    rng = random.Random(4)
    rows = [(k, " ".join(f"w{rng.randrange(50000)}" for _ in range(200))) for k in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    before, setting = shuffled(), spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    out = lm_scoring.score(df, spark.createDataFrame([(1,), (2,)], "doc_id long"))  # up to the answers; the rest runs on collect
    left = sum(n for path, n in shuffled().items() if path not in before)
    assert left < 100_000, f"{left} bytes"  # 100,000 pairs of 12 bytes were dealt
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == setting
    assert sorted(r["doc_id"] for r in out.collect()) == list(range(500))


def test_surrogates(spark, awkward):
    key = b"k"
    text = "Mr. John Smith (john.smith@mail.example.com, 10.1.2.3) and Mary Jones: +1 (743) 555-3824, 4111 1111 1111 1111, token = \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\", DE89 3704 0044 0532 0130 00. John Smith again, john.smith@mail.example.com."
    new, spans = pii.replace(text, key)
    kinds = [k for _, _, k in spans]
    assert sorted(set(kinds)) == ["card", "email", "iban", "ip", "name", "phone", "secret"] and kinds.count("name") == 3
    for a, b, _ in spans:
        assert text[a:b] not in new
    again, _ = pii.replace("John Smith", key)
    assert new.count(again) == 2 and again.split()[0] in pii.GIVEN["latin", "m"].split()
    assert pii._luhn(re.sub(r"\D", "", re.search(r"\d{4} \d{4} \d{4} \d{4}", new)[0])) == 0
    assert pii._iban_rest(re.search(r"DE\d\d[ 0-9]+", new)[0].strip()) == 1
    assert pii.replace("Plain text of 2024-01-01, v1.2.3, 1,000.50 and 12:30:05. The Quick Brown Fox", key)[1] == []
    out = pii.redact(awkward, key).collect()
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in out) == sorted((str(i), str(t)) for i, t, _ in AWKWARD)


def test_names_by_title_context_and_coreference(spark):
    key = b"k"
    text = "Contact John Smith or Dr. Priya Patel. Mr. Smith said that Smith knew Patel; Kwame Mensah (kwame@x.example.org) met Priya. Dear Li Wei, ask 王小明先生. Mr Иванов came."
    new, spans = pii.replace(text, key)
    for word in ("Smith", "Priya", "Patel", "Kwame", "Mensah", "Wei", "王小明", "Иванов", "John"):
        assert word not in new, word
    assert all(w in new for w in ("Contact ", "Dr. ", "Mr. ", "Dear ", "先生", "Mr "))
    smith = pii.replace("Mr. Smith", key)[0].split()[1]
    assert new.count(smith) == 3 and pii.replace("John Smith", key)[0].endswith(smith)
    a, b = pii.replace("+1 (743) 555-3824", key)[0], pii.replace("743-555-3824", key)[0]
    assert pii._digits(a)[1:] == pii._digits(b) != "7435553824"
    six = pii.replace("at 2001:db8::8a2e:370:7334, or 2001:0db8:0:0:0:8a2e:0370:7334", key)
    assert len(six[1]) == 2 and len(set(re.findall(r"2001:[0-9a-f:]+", six[0]))) == 1 and "370:7334" not in six[0]
    clean = "The Quick Brown Fox. New York is far. In March He went. Der Hund Und die Katze. От Москвы До Киева 12:30:05 a::b"
    assert pii.replace(clean, key) == (clean, [])
    many = " ".join(f"user{k}@mail.example.com" for k in range(40_000))
    began = time.time()
    pii.entities(many)
    pii.entities("John Smith and Anna Jones met. " * 20_000)
    assert time.time() - began < 30
    df = spark.createDataFrame([(1, "x", "John Smith")], "doc_id long, n_entities string, text string")
    assert pii.redact(df, key).columns == ["doc_id", "text", "n_entities", "entity_kinds"] and pii.redact(df.where("false"), key).count() == 0


def test_surrogates_are_distinct():
    words = [f"{a}{b}{c}" for a in "BDFG" for b in "aeiou" for c in "nrst"]
    assert len({pii._name_part("family", w, b"k") for w in words}) == len(words)
    key = b"k"
    cards = {pii.surrogate("card", f"4{k:015d}", key) for k in range(3000)}
    assert len(cards) == 3000
    p = pii.Permutation(key, 1000, b"t")
    assert sorted(p.shift(x) for x in range(1000)) == list(range(1000)) and all(p.shift(x) != x for x in range(1000))


def test_packing(spark, awkward, empty):
    want = encoded(WORD, 1)
    got = packing.pack(awkward, WORD, length=64, window_tokens=512).collect()
    texts = defaultdict(list)
    for i, t, _ in AWKWARD:
        texts[i].append(want(t))
    total = sum(len(x) for v in texts.values() for x in v)
    assert sum(r["length"] for r in got) == total
    place = sorted((r["sequence_id"], r["offset"], r["length"]) for r in got)
    at = 0
    for s, o, n in place:
        assert s * 64 + o == at and o + n <= 64
        at += n
    for r in got:
        assert any(zlib.crc32(x[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] and len(x) == r["doc_tokens"] for x in texts[r["doc_id"]])
    assert packing.pack(empty, WORD).count() == 0


def test_packing_mixes_sources(spark):
    docs = spark.createDataFrame([(k, "tok " * 50, "a" if k % 4 else "b") for k in range(400)], SCHEMA)
    got = packing.pack(docs, WORD, window_tokens=2048).toPandas()
    share = got[got["source"] == "b"].groupby("window")["length"].sum() / got.groupby("window")["length"].sum()
    assert (share.iloc[:-1] - 0.25).abs().max() < 0.06


def test_packing_refuses_shares_without_a_place(spark):
    docs = spark.createDataFrame([(1, "a b", "a"), (2, "c", "b")], SCHEMA)
    for shares in ({"a": 0}, {"a": 1, "b": 0}, {"a": 1}, {}):
        with pytest.raises(ValueError):
            packing.pack(docs, WORD, shares=shares)
    assert packing.pack(docs, WORD, shares={"a": 1, "b": 3, "c": 1}).count() == 2


def test_huffman_round_trip(spark, awkward, empty):
    want = encoded(BYTE, 2)
    path = common.fresh_path(spark, "test-huffman")
    huffman.write(awkward, path, BYTE, 2)
    got = sorted(huffman.read(spark, path).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted((i for i, _, _ in AWKWARD if i is not None)) + [None]
    texts, at = defaultdict(set), 0
    for i, t, _ in AWKWARD:
        texts[i].add((len(want(t)), zlib.crc32(want(t).tobytes())))
    for r in got:
        assert r["start"] == at and (r["n_tokens"], r["ids_crc32"]) in texts[r["doc_id"]]
        at += r["n_tokens"]
    path = common.fresh_path(spark, "test-huffman")
    huffman.write(empty, path, BYTE, 2)
    assert huffman.read(spark, path).count() == 0


def test_code_lengths():
    rng = np.random.default_rng(1)
    counts = (rng.pareto(0.6, 3000) * 10).astype(np.int64)
    lengths = huffman.code_lengths(counts, 14)
    used = lengths[lengths > 0].astype(float)
    assert lengths.max() <= 14 and (lengths[counts > 0] > 0).all() and (2.0**-used).sum() <= 1
    ids = rng.choice(np.flatnonzero(counts), 5000)
    payload, at = huffman.pack_bits(ids, huffman.canonical(lengths), lengths)
    assert (huffman.Table(lengths).decode(payload, len(ids), at[:: huffman.STRIDE]) == ids).all()
    assert list(huffman.code_lengths(np.array([0, 5, 0]))) == [0, 1, 0]
    assert sorted(huffman.code_lengths(np.array([1, 1, 2, 4]))) == [1, 2, 3, 3]
