"""HTML extraction, embeddings, components and the pipeline against brute force."""

import random

import numpy as np

from vigil.llm import common, embeddings, html_extract, language
from vigil.llm.common import components
from vigil.llm.html_blocks import blocks, features


def test_field_on_held_out_pages():
    field, right, n = html_extract.model(), 0, 0
    for html, main in html_extract.labelled_pages(80, 77):
        found = blocks(html)
        right += sum(int(y) == int(b[0] in main) for b, y in zip(found, field.best(features(found))))
        n += len(found)
    assert right / n > 0.98


def test_viterbi_and_marginals_against_all_labellings():
    field, r = html_extract.Field(), np.random.default_rng(3)
    field.w, field.pair = r.normal(size=field.w.shape), r.normal(size=(2, 2))
    rows = [np.sort(r.choice(field.w.shape[0], 4, replace=False)) for _ in range(7)]
    s = field.scores(rows)
    total = {}
    for code in range(2**7):
        y = [code >> i & 1 for i in range(7)]
        total[code] = sum(s[i, y[i]] for i in range(7)) + sum(field.pair[a, b] for a, b in zip(y, y[1:]))
    best = max(total, key=total.get)
    assert field.best(rows).tolist() == [best >> i & 1 for i in range(7)]
    p = np.exp(np.array(list(total.values())) - max(total.values()))
    p /= p.sum()
    marginal, _ = field.marginals(s)
    assert np.allclose(marginal[:, 1], [sum(p[c] for c in total if c >> i & 1) for i in range(7)])


def test_pages(spark):
    page = (
        "<!DOCTYPE html><html><head><title>t</title><script>var a='</p>';</script></head><body><nav><ul><li><a href=/>Start</a></li></ul></nav>"
        "<div class=ad>Kauf jetzt.</div><article><h1>Der  Titel &amp; mehr.</h1><p><b>Ein langer Satz steht hier,\nmit Komma.<br>Noch einer.<p>Und ein zweiter Absatz, auch lang genug.</p></article>"
        "<section class=comments><div class=comment><p>Ich bin ein Leser, und ich sage etwas.</p></div></section><footer>&copy; Haus &middot; Recht.</footer>"
    )
    rows = [(1, "u", page, 1), (2, None, None, 2), (3, "v", "", 3), (4, "w", "<div <p>& <", 4), (None, "x", page, 5)]
    got = {r.page_id: r for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()}
    assert got[1].text == "Der Titel & mehr.\n\nEin langer Satz steht hier, mit Komma. Noch einer.\n\nUnd ein zweiter Absatz, auch lang genug."
    assert got[1].n_chars == len(got[1].text) and got[None].text == got[1].text
    assert got[2].text == got[3].text == "" and got[2].n_chars == 0
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


#: Layouts written by hand, which the generator of labelled pages doesn't make: (page, main blocks).
LAYOUTS = [
    ("<body><p>Uno dos tres cuatro cinco.</p><p>Seis siete ocho nueve diez.</p></body>", ["Uno dos tres cuatro cinco.", "Seis siete ocho nueve diez."]),
    ("<div class=content>line a<br>line b</div>", ["line a line b"]),
    ("<nav><a href=/>Home</a> <a href=/a>All</a></nav><main><h1>Sources</h1><p>These are the sources of the text, in order.</p><ul>" + "".join(f"<li><a href=/{i}>Source number {i}</a></li>" for i in range(30)) + "</ul><p>The list ends here, and so does this page.</p></main>",
     ["Sources", "These are the sources of the text, in order.", *[f"Source number {i}" for i in range(30)], "The list ends here, and so does this page."]),
    ("<div class='kopfzeile'><span>Die Zeitung</span></div><div class='hauptmenue'><ul><li><a href=/1>Politik</a></li><li><a href=/2>Sport</a></li><li><a href=/3>Kultur</a></li></ul></div><div class='beitrag'><h1>Der Fluss steigt</h1><p>Seit Tagen regnet es, und der Fluss steigt weiter.</p><p>Die Stadt hat die Brücke gesperrt.</p></div><div class='fusszeile'><p>© Die Zeitung | Impressum</p></div>",
     ["Der Fluss steigt", "Seit Tagen regnet es, und der Fluss steigt weiter.", "Die Stadt hat die Brücke gesperrt."]),
    ("<div class=zq><h1>A walk</h1><p>We left the house early, before it was light.</p><p>It was cold, and nobody spoke.</p></div><aside class=sidebar><h3>Popular</h3><ul><li><a href=/x>One thing</a></li><li><a href=/y>Another thing</a></li></ul></aside><footer>© 2020 Walks</footer>",
     ["A walk", "We left the house early, before it was light.", "It was cold, and nobody spoke."]),
    ("<article><h1>Bread</h1><p>Flour, water and salt are enough.</p><div class=ad>Buy our new oven today.</div><p>Let it rest for a night.</p></article><section class=comments><h3>Comments</h3><div class=comment><b>Ann</b><p>I tried this and it was good.</p></div></section>",
     ["Bread", "Flour, water and salt are enough.", "Let it rest for a night."]),
    ("<div id=cookie-notice><p>We use cookies. Accept our policy.</p><button>OK</button></div><article><h2>Short</h2><p>One line only.</p></article>", ["Short", "One line only."]),
    ("<header><div>The Site</div><nav><ul><li><a href=/>Start</a></li><li><a href=/b>Blog</a></li></ul></nav></header><main><article><header><h1>On rain</h1></header><blockquote><p>It falls on all alike.</p></blockquote><pre>mm = 3</pre></article></main><form class=search><label>Search</label><input name=q></form>",
     ["On rain", "It falls on all alike.", "mm = 3"]),
    ("<div class=contenido><h1>El mar</h1><p>El mar estaba en calma aquella mañana, y salimos.</p><ol><li>Remos</li><li>Red</li><li>Pan</li></ol></div><div class=publicidad>Compre ahora.</div><div class=pie><p>© Diario</p></div>",
     ["El mar", "El mar estaba en calma aquella mañana, y salimos.", "Remos", "Red", "Pan"]),
    ("<html><head><title>x</title><script>var a='<p>no</p>'</script></head><body><div class=menu><ul><li><a href=/1>A</a></li><li><a href=/2>B</a></li><li><a href=/3>C</a></li></ul></div><div class=story><h1>Glass &amp; sand</h1><p>Sand melts at a heat that few ovens reach.</p></div>",
     ["Glass & sand", "Sand melts at a heat that few ovens reach."]),
]


def test_pages_of_other_layouts():
    field = html_extract.model()
    assert [html_extract.main_text(page, field) for page, _ in LAYOUTS] == ["\n\n".join(main) for _, main in LAYOUTS]


def test_long_and_repeated_pages(spark):
    passages = [f"Absatz {i} ist lang genug, und er hat ein Komma." for i in range(20_000)]
    page = "<nav><a href=/>Start</a></nav><article><h1>Ein Titel</h1>" + "".join(f"<p>{x}</p>" for x in passages) + "</article><footer>© Haus</footer>"
    df = spark.createDataFrame([(1, "u", page), (1, "u", page), (2, "u", page)], "page_id long, url string, html string")
    got = html_extract.extract(df).collect()
    assert len(got) == 3 and {r.text for r in got} == {"\n\n".join(["Ein Titel", *passages])}


def brute(vectors, labels, least):
    x = vectors / np.sqrt((vectors**2).sum(1, keepdims=True))
    near = (x @ x.T >= least) & (labels[:, None] == labels)
    np.fill_diagonal(near, False)
    return near


def test_embeddings(spark):
    r = np.random.default_rng(9)
    base = r.normal(size=(150, 16))
    near = base[r.integers(0, 150, 250)] + 0.04 * r.normal(size=(250, 16))
    same = np.repeat(base[:1], 60, 0)
    vectors = np.concatenate([base, near, same])
    labels = np.concatenate([np.arange(150) % 3, r.integers(0, 3, 250), np.zeros(60, int)])
    rows = [(i, v.tolist(), int(l)) for i, (v, l) in enumerate(zip(vectors, labels))]
    odd = [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, vectors[0].tolist(), None), (904, [None] + [1.0] * 15, 1), (905, [], 1), (None, vectors[0].tolist(), 0), (906, [1.0, 2.0], 1)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int").repartition(5)
    got = {x.vec_id: x for x in embeddings.near_duplicates(df, window=16).collect()}
    assert len(got) == len(rows) + len(odd)
    true = brute(vectors, labels, 0.98)
    found = np.array([got[i].n_links for i in range(len(rows))])
    assert (found <= true.sum(1)).all() and found.sum() >= 0.9 * true.sum()
    for i in range(len(rows)):
        assert got[i].kept == (got[i].component_id == i) and got[i].component_id <= i
    for i, *_ in odd:
        assert got[i].n_links == 0 and got[i].component_id == i and got[i].kept


def test_embeddings_of_a_large_group(spark):
    # far more near copies than the windows of all passes hold, with a few vectors around
    r = np.random.default_rng(5)
    base = r.normal(size=(1, 32))
    vectors = np.concatenate([base + 0.07 * r.normal(size=(3000, 32)), r.normal(size=(200, 32))])
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, label int").repartition(5)
    got = {x.vec_id: x for x in embeddings.near_duplicates(df).collect()}
    true = brute(vectors, np.zeros(len(vectors)), 0.98).sum(1)
    assert true.max() > 2500 and [got[i].n_links for i in range(len(vectors))] == true.tolist()
    assert {got[i].component_id for i in range(3000)} == {0}


def test_embeddings_of_a_group_with_cores_and_outer_vectors(spark):
    # most vectors lie near the centre, some so far out that they link with a part of the group only; copies count
    r = np.random.default_rng(8)
    base = r.normal(size=(1, 24))
    spread = np.concatenate([np.full(1800, 0.05), np.full(700, 0.16)])[:, None]
    vectors = base + spread * r.normal(size=(2500, 24))
    vectors[1700:1800] = vectors[0]
    df = spark.createDataFrame([(i, v.tolist(), "a") for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, label string").repartition(5)
    got = {x.vec_id: x for x in embeddings.near_duplicates(df).collect()}
    true = brute(vectors, np.zeros(len(vectors)), 0.98).sum(1)
    found = np.array([got[i].n_links for i in range(len(vectors))])
    assert 0 < (true < 1500).sum() and (found <= true).all() and found.sum() >= 0.99 * true.sum()


def test_embeddings_of_none_and_clashing_names(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embeddings.near_duplicates(none).count() == 0
    rows = [(1, [1.0, 0.0], 1.2, 5, b"x"), (2, [1.0, 0.0], 1.4, 5, b"x"), (3, [2.0, 0.0], 1.2, 5, b"x"), (3, [2.0, 0.0], 1.2, 5, b"x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label double, rep long, vec binary")
    got = sorted((x.vec_id, x.n_links, x.component_id) for x in embeddings.near_duplicates(df).collect())
    assert got == [(1, 2, 1), (2, 0, 2), (3, 2, 1), (3, 2, 1)]


def test_components(spark):
    r = random.Random(2)
    links = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(70)] + [(5000, 5000 + i) for i in range(1, 50)] + [(7, 7)]
    label = {}

    def find(x):
        while label.setdefault(x, x) != x:
            x = label[x]
        return x

    for a, b in links:
        if a != b:
            a, b = sorted((find(a), find(b)))
            label[b] = a
    got = {x.node: x.component for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in label}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pipeline(spark):
    import base64
    import re

    import corpus_pipeline
    import public_tokenizers as P
    import tiktoken

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    seen = [{r.doc_id: r.text or "" for r in docs.collect()}]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, d)
        assert out.columns == docs.columns
        path = common.scratch(spark, "test")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        seen.append({r.doc_id: r.text or "" for r in docs.collect()})
    # near duplicates: the smallest of each group stays
    before, after = seen[1], seen[2]
    lower = {i: i + 32 for i in range(65, 91)}
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t.translate(lower)) for i, t in before.items()}
    sets = {i: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()} for i, w in words.items()}
    comp = {i: i for i in sets}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                comp[y] = x
    assert set(after) == {i for i in sets if find(i) == i} and len(after) < len(before)
    # leaks: what goes holds a test item, as far as exact passages tell
    items = [r.text for r in spark.read.parquet(f"{d}/benchmark.parquet").collect() if r.text]
    assert all(not any(t in x for t in items) for x in seen[3].values()) and set(seen[3]) <= set(after)
    # secrets: none is left, other texts are as they were
    assert set(seen[4]) == set(seen[3])
    base = re.compile(r"AKIA[A-Z0-9]{16,}|[0-9a-f]{24,}")
    assert not any(base.search(t) for t in seen[4].values())
    assert all(seen[4][i] == t for i, t in seen[3].items() if "[SECRET]" not in seen[4][i])
    last = corpus_pipeline.STAGES[-1][1](spark, docs, d).collect()
    ranks = {base64.b64decode(x): int(y) for x, y in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    e = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert len(last) == len(seen[4])
    for r in last:
        assert r.round_trip and np.frombuffer(r.ids, "<u4").tolist() == e.encode_ordinary(seen[4][r.doc_id])


def test_stages_keep_clashing_columns(spark):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").limit(60)
    odd = docs.selectExpr("*", "1 as row", "2 as _row", "3 as declared", "4 as host", "5 as ll", "6 as secrets0", "7 as _secrets", "8 as component_id")
    for i in (0, 1, 2, 3):
        out = corpus_pipeline.STAGES[i][1](spark, odd, d)
        assert out.columns == odd.columns
        assert {tuple(r) for r in out.select("row", "_row", "declared", "host", "ll", "secrets0", "_secrets", "component_id").distinct().collect()} == {(1, 2, 3, 4, 5, 6, 7, 8)}


def test_pages_languages(spark):
    docs = spark.createDataFrame([(1, "der hund und die katze " * 30, "de", "a"), (2, "the dog and the cat " * 30, "en", "a")], "doc_id long, text string, lang string, source string")
    rows = [
        (1, "https://x.de/1", "<html lang=de><body><p>" + "die katze und der hund " * 20), (2, "https://y.com", "<html><body>" + "the cat and the dog " * 20), (3, None, None), (4, "https://x.de/2", ""),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in language.pages_report(pages, docs).collect()}
    assert (got[1].lang, got[2].lang) == ("de", "en") and got[1].accepted and got[2].accepted and not got[3].accepted and not got[4].accepted
    none = language.pages_report(pages, docs.where("false")).collect()
    assert len(none) == 4 and not any(r.accepted for r in none)
    assert language.pages_report(pages.where("false"), docs).count() == 0
