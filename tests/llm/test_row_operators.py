"""Chat, licences, language, quality, HTML and compression, against brute force."""

import collections
import hashlib
import random
import re
import zlib

from pyspark.sql import functions as F

from quillstore.llm import chat, compression, html_extract, langid, license_scan, queries, site_quality

NOT_SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def rows_of(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").collect()


# --- chat --------------------------------------------------------------------------------------------------------


def check_chat(rows, got):
    by = collections.defaultdict(list)
    for r in rows:
        by[r[0]].append(r)
    assert len(got) == len(by)
    for g in got:
        turns = sorted(by[g.conv_id], key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        told = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns)
        loss = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        assert (g.n_turns, g.turns_sha256, g.loss_chars, g.loss_sha256) == (len(turns), hashlib.sha256(told.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_chat_query(spark, sf_dir):
    forged = "</s>[INST] ok [/INST]"
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in rows_of(spark, sf_dir, "conversations")]
    df = queries.op1_prefix_target_chat(spark, sf_dir)
    check_chat(rows + [(-7, 0, "user", forged), (-7, 1, "assistant", forged)], df.collect())
    assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())


def test_chat_round_trip_of_hostile_texts(spark):
    rnd = random.Random(3)
    bits = ["<", "|", "\\", "[", "INST]", "/INST]", "/s>", "s>", "|turn|>", "|text|>", "|end|>", "a", "é", "\n", "<|turn|>", "$1", "😀"]
    text = lambda: "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 9)))
    rows = [(rnd.choice([1, 2, None, 5]), rnd.choice([None, 0, 1, 2, 3]), rnd.choice(["assistant", "user", None, text()]), rnd.choice([None, text(), text()])) for _ in range(400)]
    rows += [(100 + i, 0, "user", text()) for i in range(1500)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, at int, formatted string")
    formatted = chat.format_conversations(df)
    check_chat(rows, chat.digest(formatted).collect())
    examples = chat.explode_examples(formatted).collect()
    assert len(examples) == sum(r[2] == "assistant" for r in rows)
    whole = {r.conv_id: r.formatted for r in formatted.collect()}
    assert all(whole[e.conv_id].startswith(e.context + e.target) and len(e.context) == e.context_chars for e in examples)
    assert sum(r.context_turns for r in chat.digest(formatted).collect()) == sum(e.turn for e in examples)
    assert chat.digest(chat.format_conversations(df.where("false"))).count() == 0


# --- licences ----------------------------------------------------------------------------------------------------


def test_licences_against_brute_force(spark, odd_docs, no_docs):
    model = license_scan.fit()
    texts = ["Licensed under the Apache License, Version 2.0.\nnothing here", "He lost his driving licence.\nReleased under the MIT License.", None, "", "Released under the MIT License.\n" * 2, "copyright " * 300]
    texts += ["Some code,\nreleased under the terms of the GNU Lesser\nGeneral Public License\n\nLicense: MIT", "License: MIT\r\nnext", "Licensed under\n\nthe MIT License."]
    texts += [t for _, t in license_scan.table()[::29]]
    rows = list(enumerate(texts)) + [(0, texts[0]), (None, "SPDX-License-Identifier: GPL-3.0")]
    df = spark.createDataFrame([(i, t, "x", 0.5) for i, t in rows], "doc_id long, text string, family string, probability double")
    out = license_scan.scan(df, model)
    expected = []
    for i, t in rows:
        for n, line in enumerate(license_scan.python_paragraphs(t)):
            family, p = license_scan.python_predict(model, line)
            if family != license_scan.UNKNOWN and p >= model.threshold:
                alike = license_scan.python_similarity(model, line, family)
                expected.append((str(i), n, family, round(p, 4), round(alike, 6), alike >= 0.5, family if alike >= 0.5 else "unknown"))
    assert sorted((str(r.doc_id), r.paragraph, r.family, round(r.probability, 4), round(r.similarity, 6), r.confirmed, r.verdict) for r in out.collect()) == sorted(expected)
    assert {"Apache", "MIT", "GPL"} <= {r.family for r in out.collect()} and not re.search("Python|Pandas|Arrow", out._jdf.queryExecution().executedPlan().toString())
    assert license_scan.scan(odd_docs, model).count() == 0 and license_scan.scan(no_docs, model).count() == 0


def test_licences_need_no_anchor_word(spark):
    texts = ["Released under GPLv3.", "Distributed under the terms of AGPL-3.0.", "This project is available under CC BY-SA 4.0.", "You may use this file under the terms of Apache 2.0.", "Er kam mit dem Bus.", "Mit."]
    got = license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.family for r in got} == {0: "GPL", 1: "AGPL", 2: "CC-BY-SA", 3: "Apache"}


def test_telling_words_skip_nothing_that_can_be_named():
    model = license_scan.fit()
    words = {w for g, _, _ in model.weights for w in g.split(" ")} - set(license_scan.telling_words(model))
    weights = [x for x in model.weights if words.issuperset(x[0].split(" "))]
    of = lambda g, f: sum(w for h, k, w in weights if h == g and k == f)
    grams = {g for g, _, _ in weights}
    for f, b in zip(model.families, model.biases, strict=True):
        if f != license_scan.UNKNOWN:
            most = sum(max(0, of(g, f) - of(g, license_scan.UNKNOWN)) for g in grams)
            assert b + most < model.biases[model.families.index(license_scan.UNKNOWN)]


def test_licence_model_on_held_out_notices():
    rows = license_scan.table()
    held = license_scan.held_out(rows)
    model = license_scan.fit(train=~held)
    unseen = dict.fromkeys(r for r, out in zip(rows, held, strict=True) if out)
    assert not {t for _, t in unseen} & {t for (_, t), out in zip(rows, held, strict=True) if not out}
    assert sum(license_scan.python_predict(model, t)[0] == f for f, t in unseen) >= 0.95 * len(unseen)


def test_every_notice_of_the_table_is_found(spark):
    rows = list(dict.fromkeys(license_scan.table()))
    texts = [(i, f"Some words before it.\n{t}\n\nAnd some more.") for i, (_, t) in enumerate(rows)]
    got = {(r.doc_id, r.paragraph): r for r in license_scan.scan(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    for i, (f, _) in enumerate(rows):
        assert (i, 1) not in got if f == license_scan.UNKNOWN else (got[i, 1].family, got[i, 1].verdict) == (f, f)


def test_licences_in_documents(spark, sf_dir):
    found = {(r.doc_id, r.family) for r in queries.op2_license_paragraphs(spark, sf_dir).collect()}
    planted = {"Apache License": "Apache", "MIT License": "MIT", "GNU General Public License": "GPL", "CC BY-NC": "CC-BY-NC"}
    expected = {(r.doc_id, f) for r in rows_of(spark, sf_dir, "documents") for k, f in planted.items() if r.text and k in r.text}
    assert found == expected


# --- language ----------------------------------------------------------------------------------------------------


def test_language_on_held_out_documents(spark, sf_dir):
    docs = {r.doc_id: r for r in rows_of(spark, sf_dir, "documents")}
    got = queries.op3_language_id(spark, sf_dir).collect()
    assert {r.doc_id for r in got} == set(docs) and all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out and docs[r.doc_id].text]
    assert sum(docs[r.doc_id].lang == r.lang_pred for r in held) >= 0.97 * len(held)


def test_language_ignores_labels_sources_and_held_out_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    other = docs.withColumn("lang", F.when(langid.held_out(), "xx").otherwise(F.col("lang"))).withColumn("source", F.lit("z"))
    a, b = (langid.fit(langid.training_rows(d)) for d in (docs, other))
    assert a.languages == b.languages and (a.weights == b.weights).all()


def test_language_odd_rows(spark, sf_dir, odd_docs, no_docs, odd_rows):
    model = langid.fit(langid.training_rows(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    got = langid.identify(odd_docs, model).collect()
    letters = lambda t: any(c.isalpha() for c in t or "")
    assert collections.Counter((r.doc_id, r.lang_pred == "und") for r in got) == collections.Counter((i, not letters(t)) for i, t in odd_rows)
    assert langid.keep_identified(odd_docs, model).columns == odd_docs.columns
    assert langid.keep_identified(odd_docs, model).count() == sum(letters(t) for _, t in odd_rows)
    assert langid.identify(no_docs, model).count() == 0
    nothing = langid.fit(no_docs.select("doc_id", "text", "lang"))
    assert {r.lang_pred for r in langid.identify(odd_docs, nothing).collect()} == {"und"}


def test_viterbi_against_enumeration():
    import itertools

    import numpy as np

    rnd = np.random.default_rng(2)
    counts = np.array([1, 4, 0, 6, 3])
    scores = rnd.normal(size=(counts.sum(), 3)) * 3
    first = np.cumsum(counts) - counts
    labels = langid.best_paths(scores, first, counts, 2.0)
    for a, n in zip(first, counts, strict=True):
        value = lambda p, a=a: sum(scores[a + i, k] for i, k in enumerate(p)) - 2.0 * sum(x != y for x, y in itertools.pairwise(p))
        if n:
            assert abs(value(labels[a : a + n]) - max(map(value, itertools.product(range(3), repeat=int(n))))) < 1e-9


def test_spans_of_mixed_text(spark, sf_dir):
    docs = rows_of(spark, sf_dir, "documents")
    model = langid.fit(langid.training_rows(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    part = {k: " ".join(next(r.text for r in docs if r.lang == k and r.text and len(r.text.split()) > 60 and langid.predict([r.text], model, langid.Options())[1][0] == 1).split()[:40]) for k in ("de", "fr")}
    got = langid.spans(spark.createDataFrame([(1, f"{part['de']} {part['fr']}"), (2, None)], "doc_id long, text string"), model).orderBy("span").collect()
    assert [r.lang for r in got] == ["de", "fr"] and abs(got[0].n_words - got[1].n_words) < 20


# --- site quality ------------------------------------------------------------------------------------------------


def test_site_quality_query(spark, sf_dir):
    labels = {r.doc_id: r.quality for r in rows_of(spark, sf_dir, "labels")}
    got = queries.op4_site_quality(spark, sf_dir).collect()
    assert len(got) == len(rows_of(spark, sf_dir, "documents"))
    known = [r for r in got if r.doc_id in labels]
    assert sum(r.kept == (labels[r.doc_id] > 0) for r in known) >= 0.97 * len(known)


def test_posteriors_against_brute_force(spark):
    import math

    rnd = random.Random(4)
    rows = [(i, f"h{i % 7}" if i % 11 else "", f"p{i % 3}", rnd.gauss((i % 7) / 2 - 1, 1)) for i in range(500)] + [(1000, "lone", "only", 9.0)]
    got = {r.doc_id: r for r in site_quality.posteriors(spark.createDataFrame(rows, "doc_id long, host string, path string, log_odds double")).collect()}
    p = {r[0]: 1 / (1 + math.exp(-r[3])) for r in rows}

    def strength(groups, centre):
        k, n = len(groups), sum(map(len, groups.values()))
        mean = {g: sum(v) / len(v) for g, v in groups.items()}
        noise = sum((x - mean[g]) ** 2 for g, v in groups.items() for x in v) / (n - k)
        between = sum(len(v) * (mean[g] - centre(g)) ** 2 for g, v in groups.items())
        spread = (between - (k - 1) * noise) / (n - sum(len(v) ** 2 for v in groups.values()) / n)
        return min(1000.0, noise / spread) if spread > 0 else 1000.0

    hosts, paths = collections.defaultdict(list), collections.defaultdict(list)
    for i, h, q, _ in rows:
        hosts[h].append(p[i])
        paths[h, q].append(p[i])
    base = sum(p.values()) / len(p)
    kh = strength(hosts, lambda _: base)
    host = {h: (sum(v) + kh * base) / (len(v) + kh) for h, v in hosts.items()}
    kp = strength(paths, lambda g: host[g[0]])
    odds = lambda x: math.log(x / (1 - x))
    for i, h, q, z in rows:
        of_host = (sum(hosts[h]) - p[i] + kh * base) / (len(hosts[h]) - 1 + kh)
        path = (sum(paths[h, q]) - p[i] + kp * of_host) / (len(paths[h, q]) - 1 + kp)
        quality = 1 / (1 + math.exp(-(z + odds(path) - odds(base))))
        assert abs(got[i].path_quality - path) < 1e-9 and abs(got[i].host_quality - of_host) < 1e-9 and abs(got[i].quality - quality) < 1e-9


def test_site_quality_odd_rows(spark, odd_docs, no_docs, odd_rows):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (5, None, 0), (None, 1, 0), (7, 0, 1), (8, 0, 0), (30, 1, 0)], "doc_id long, quality int, toxic int")
    got = site_quality.site_quality(odd_docs, labels, F.col("source"), F.col("lang"))
    assert got.count() == len(odd_rows) and got.where("kept is null or quality is null").count() == 0
    assert site_quality.site_quality(no_docs, labels, F.col("source"), F.col("lang")).count() == 0
    assert site_quality.site_quality(odd_docs, labels.where("false"), F.col("source"), F.col("lang")).count() == len(odd_rows)


def test_best_paths_with_many_languages():
    import numpy as np

    scores = np.zeros((200, 300))
    scores[:100, 290] = scores[100:, 140] = 5.0
    labels = langid.best_paths(scores, np.array([0]), np.array([200]), 2.0)
    assert labels.tolist() == [290] * 100 + [140] * 100


# --- HTML --------------------------------------------------------------------------------------------------------


def test_pages_query(spark, sf_dir):
    """The pages of the driver hold one article of paragraphs; everything else on them is not main text."""
    import html as H

    got = {r.page_id: r for r in queries.op6_html_block_tree(spark, sf_dir).collect()}
    for r in rows_of(spark, sf_dir, "pages"):
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        parts = [" ".join(H.unescape(re.sub("<br>", " ", re.sub("</?b>", "", p))).split()) for p in re.split("</?(?:p|h1)>", article)]
        expected = "\n\n".join(p for p in parts if p)
        assert (got[r.page_id].text, got[r.page_id].n_chars, got[r.page_id].url) == (expected, len(expected), r.url)


LONG = "This is the main text of a page, long enough to look like one, with several clauses and a full stop at its end, as paragraphs of articles have them."
CASES = {
    f"<html><head><title>t</title></head><body><header class=site>Site</header><nav><a>x</a></nav><main><h2>Head</h2><p>one &amp; two<p>three &lt;b&gt;<ul><li>item</ul></main><aside>side</aside><div id=comments><p>{LONG}</p></div></body>": "Head\n\none & two\n\nthree <b>\n\nitem",
    f"<div class='wrap has-sidebar'><article><header><h1>T</h1></header><p>{LONG}</p><div class='share'>Share</div><form>Name <input></form></article><div class=sidebar>{LONG}</div></div>": f"T\n\n{LONG}",
    f"<body><div class='cookie-notice'>We use cookies</div><article><p>a&nbsp;b\n c</p><script>var t='</p>';</script><!-- <p>no</p> --><p>d</article><footer>f</footer>": "a b c\n\nd",
    f"<div><ul><li><a href=/1>One</a></li><li><a href=/2>Two</a></li></ul></div><div><h1>Title of it</h1><p>{LONG}</p><p>{LONG}</p></div><div>Legal <a>about</a> <a>terms</a></div>": f"Title of it\n\n{LONG}\n\n{LONG}",
    "<article><p>a < b and c > d</p><p>cut <b": "a < b and c > d\n\ncut",
    f"<article class=post><div class='entry-header'><h1>T</h1><p class=teaser>Lead</p></div><p>{LONG}</p><p class='notice'>N</p><div class='ad-box'>Buy</div></article>": f"T\n\nLead\n\n{LONG}",
    "plain": "plain",
    "": "",
    None: "",
}


def test_html_cases(spark):
    rows = [(i, "u" if i % 2 else None, p, "x") for i, p in enumerate(CASES)] + [(0, "u", next(iter(CASES)), "y")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html_extract.extract(df)
    assert sorted((r.page_id, r.text) for r in got.collect()) == sorted([(r[0], CASES[r[2]]) for r in rows])
    assert html_extract.extract(df.where("false")).count() == 0


def test_html_short_paragraphs_and_long_boilerplate():
    tree = html_extract.grow(*html_extract.labelled_table())
    menu = "<div><ul><li><a href=/1>One</a></li><li><a href=/2>Two</a></li></ul></div>"
    short = ["Yes, she said.", "No.", "He did not answer her at all."]
    page = f"{menu}<div><h1>Title of it</h1><p>{LONG}</p>" + "".join(f"<p>{p}</p>" for p in short) + f"<p>{LONG}</p></div>{menu}"
    assert html_extract.main_text(page, tree) == "\n\n".join(["Title of it", LONG, *short, LONG])
    for start, end in (("<div>", "</div>"), ("<main>", "</main>")):  # no heading after the menu
        assert html_extract.main_text(f"{menu}{start}<p>{LONG}</p><p>{short[0]}</p><p>{LONG}</p>{end}{menu}", tree) == "\n\n".join([LONG, short[0], LONG])
    assert html_extract.main_text(f"{menu}<div><h1>Title of it</h1><p><a href=/3>By one</a></p><p>{LONG}</p></div>{menu}", tree) == f"Title of it\n\n{LONG}"
    longer = " ".join([LONG] * 3)
    for kind in ("comments", "notice", "sidebar"):
        page = f"{menu}<div><h1>Title of it</h1><p>{LONG}</p><p>{short[0]}</p><p>{LONG}</p></div><div class={kind}><p>{longer}</p><p>{LONG}</p></div>"
        assert html_extract.main_text(page, tree) == "\n\n".join(["Title of it", LONG, short[0], LONG])


def test_html_boilerplate_of_any_length():
    tree = html_extract.grow(*html_extract.labelled_table())
    words = lambda kind, n: " ".join([kind] * n)
    inner = f"<h1>Title</h1><p>{words('main', 60)}</p><p>{words('main', 8)}</p><p>{words('main', 50)}</p>"
    text = "\n\n".join(["Title", words("main", 60), words("main", 8), words("main", 50)])
    for main in (f"<article>{inner}</article>", f"<div>{inner}</div>"):
        for n in (1, 3, 10, 40, 120, 500):
            for start, end in (("<section class=comments><p>", "</p></section>"), ("<aside class=sidebar><p>", "</p></aside>"), ("<div class=advert><p>", "</p></div>"), ("<form><p>", "</p></form>"), ("<footer><h4>", "</h4></footer>"), ("<nav><p>", "</p></nav>"), ("<div class='cookie-notice'>", "</div>")):
                other = start + words("drop", n) + end
                assert html_extract.main_text(main + other, tree) == html_extract.main_text(other + main, tree) == text


def test_html_links_and_names_inside_articles():
    tree = html_extract.grow(*html_extract.labelled_table())
    assert html_extract.main_text(f"<nav><a>Home</a></nav><div><p>{LONG}</p><p>{LONG}</p></div>", tree) == f"{LONG}\n\n{LONG}"
    links = "<ul><li><a href=/a>One two three</a></li><li><a href=/b>Four five</a></li><li><a href=/c>Six</a></li></ul>"
    for after in (f"<p>{LONG}</p>", "<p>Short end.</p>"):
        assert html_extract.main_text(f"<article><p>{LONG}</p>{links}{after}</article>", tree) == f"{LONG}\n\n{after[3:-4]}"
    for tag in ("article", "div"):  # text between links
        between = f"<{tag}><p>{LONG}</p>{links}<p>{LONG}</p>{links}<p>{LONG}</p></{tag}>"
        assert html_extract.main_text(between, tree) == "\n\n".join([LONG] * 3)
    kept = f"<article><p>{LONG}</p><p><a href=/r>The whole report of it</a></p><p>{LONG}</p></article>"
    assert html_extract.main_text(kept, tree) == f"{LONG}\n\nThe whole report of it\n\n{LONG}"
    named = f"<article><p>{LONG}</p><div class='content warning-box'><p>Take care.</p></div><section id='related-work'><h2>Related work</h2><p>{LONG}</p></section><div class='related-posts'><p>{LONG}</p></div></article>"
    assert html_extract.main_text(named, tree) == f"{LONG}\n\nTake care.\n\nRelated work\n\n{LONG}"


def test_tree_fits_its_table():
    x, _ = html_extract.labelled_table()
    used = lambda t: set() if isinstance(t, bool) else {html_extract.FEATURES[t[0]]} | used(t[2]) | used(t[3])
    assert {"links", "links_before", "links_after", "words"} <= used(html_extract.grow(*html_extract.labelled_table()))
    x, y = html_extract.labelled_table()
    assert (html_extract.judge(html_extract.grow(x, y), x) == y).mean() > 0.98


# --- compression -------------------------------------------------------------------------------------------------


def base_measures(text):
    t = text or ""
    w = NOT_SPACE.findall(t)
    windows = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    marked = set()
    for i in range(len(w) - 7):
        if windows[tuple(w[i : i + 8])] > 1:
            marked.update(range(i, i + 8))
    seen, repeated = set(), 0
    for line in t.split("\n"):
        if NOT_SPACE.search(line):
            repeated += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), repeated, len(marked), len(w) < 20 or 100 * len(marked) > 30 * len(w)


def test_compression_against_brute_force(spark, sf_dir, odd_docs, odd_rows, no_docs):
    import zstandard

    limits = compression.Limits()
    rows = [(r.doc_id, r.text) for r in rows_of(spark, sf_dir, "documents")]
    for got, source in ((queries.op10_compression_bands(spark, sf_dir), rows), (compression.compression_bands(odd_docs), odd_rows)):
        got = sorted(map(tuple, got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()), key=repr)
        expected = []
        for i, t in source:
            raw = (t or "").encode()
            squeeze = lambda b: len(zstandard.ZstdCompressor(level=limits.level).compress(b))
            ratio = len(raw) / squeeze(raw) if raw else 1.0
            low, high = next((a, b) for n, a, b in limits.bands if len(raw) <= n)
            chunks = [raw[x : x + 4096] for x in range(0, len(raw), 4096)]
            limit = lambda c: (limits.chunk_low, limits.chunk_high) if len(c) == 4096 else next((a, b) for n, a, b in limits.bands if len(c) <= n)
            bad = sum(len(c) for c in chunks if not limit(c)[0] <= len(c) / squeeze(c) <= limit(c)[1]) / max(1, len(raw))
            base = base_measures(t)
            expected.append((i, *base, not base[-1] and low <= ratio <= high and bad < limits.bad_chunk_share))
        assert got == sorted(expected, key=repr)
    assert compression.compression_bands(no_docs).count() == 0
    kept = compression.keep_compressible(odd_docs)
    assert kept.columns == odd_docs.columns and kept.count() == compression.compression_bands(odd_docs).where("kept").count()


def test_compression_rejects_both_ends(spark):
    rnd = random.Random(1)
    noise = " ".join("".join(rnd.choice([chr(c) for c in range(0x21, 0x7F)]) for _ in range(12)) for _ in range(900))
    plain = " ".join("".join(rnd.choice(["the", "an", "er", "in", "on", "th", "re"]) for _ in range(rnd.randint(1, 3))) for _ in range(900))
    loops = " ".join(f"{i % 9}loop{i % 5}" for i in range(400))
    got = compression.compression_bands(spark.createDataFrame([(1, noise), (2, plain), (3, loops)], "doc_id long, text string")).collect()
    assert {r.doc_id: r.kept for r in got} == {1: False, 2: True, 3: False}


def test_compression_covers_tails(spark):
    rnd = random.Random(2)
    stems = ["the", "house", "river", "under", "walked", "morning", "quiet", "letter", "stone", "answer", "garden", "window", "often", "with", "small", "many"]
    english = lambda n: " ".join(rnd.choice(stems) + rnd.choice(["", "s", "ed", "ing"]) + rnd.choice([" a", " of", "", ","]) for _ in range(n))[:n]
    noise = lambda n: "".join(chr(rnd.randint(0x21, 0x7E)) for _ in range(n))
    plain, bad = english(4096), noise(4000)
    texts = [plain + " " + bad, bad + " " + plain, plain + " " + "a" * 3900, plain + " " + english(3000), plain * 2 + " " + noise(300)]
    got = {r.doc_id: r for r in compression.compression_bands(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i].bad_chunk_share > 0.2 for i in range(5)] == [True, True, True, False, False]
    assert not any(got[i].kept for i in range(3))
