"""Training-data operators: odd rows, empty tables, and brute force, round trips or held-out rows on small tables."""

import collections
import math
import re
import zlib

import numpy as np
import pytest

from tidepanel.llm import contamination, extraction, jaccard, licences, lines, projections, quality, scoring, shared, tokenise, toxicity

SF = "/root/testdata/sf0.001"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, score double, keep string, n_links int, row string"
BASE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen"


def words(x):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (x or "").translate(LOW))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty, tiny and very long texts, ties, repeated rows, and columns that clash."""
    rows = [(1, BASE), (2, BASE), (2, BASE), (3, BASE.upper() + "!"), (4, BASE + " nineteen"), (5, ""), (6, None), (None, BASE), (None, None), (7, "x"), (8, "word " * 30_000), (9, "\n\n \n"), (10, "語" * 3000)]
    return spark.createDataFrame([(i, t, 0.5, "k", 7, "r") for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_licences(spark, odd, none):
    assert licences.scan(odd).count() == 13 and licences.scan(none).count() == 0
    docs = spark.createDataFrame([(1, "Licensed under CC BY-NC 4.0. All rights reserved."), (2, "all rigts reserved"), (3, "this is the GNU General Public License, cc by")], "doc_id long, text string")
    got = {r.doc_id: r for r in licences.scan(docs).collect()}
    assert (got[1].n_base, got[1].first_word, got[1].last_word, got[1].base_labels) == (2, 2, 7, "cc-by,reserved")
    assert (got[2].n_base, got[2].base_labels, got[2].labels) == (0, "", "reserved") and 0 < got[2].score < 1
    assert got[3].base_labels == "cc-by,gpl"


def test_adjacent_notices():
    got = licences.find("all rights reservd all rights reserved")
    assert [(e, a, b) for _, e, a, b in got] == [(1, 0, 18), (0, 19, 38)]


def test_embeddings(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 16))
    x[200:] = x[:100] + rng.normal(size=(100, 16)) * rng.choice([0.02, 0.08, 0.2], (100, 1))
    rows = [(i, [float(v) for v in e], int(i % 2)) for i, e in enumerate(x)]
    odd = [(400, None, 1), (401, [], 1), (402, [0.0] * 16, 1), (403, [1.0, None] * 8, 1), (404, [float("nan")] * 16, 1), (405, rows[0][1], None), (None, rows[0][1], 0), (406, rows[0][1], 0), (406, rows[0][1], 0)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int")
    got = projections.near_duplicates(df).collect()
    assert len(got) == 309
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = (unit @ unit.T >= 0.98) & (np.arange(300)[:, None] % 2 == np.arange(300)[None, :] % 2)
    expected = links.sum(1) - 1
    expected[links[0]] += 2  # the two rows 406
    by_id = {r.vec_id: r for r in got}
    assert [by_id[i].n_links for i in range(300)] == expected.tolist()
    assert by_id[406].component_id == 0 and by_id[402].n_links == 0 and by_id[405].component_id == 405
    assert projections.near_duplicates(df.where("vec_id < 0")).count() == 0


def test_jaccard(spark, odd, none):
    got = jaccard.join(odd).collect()
    assert len(got) == 13 and jaccard.join(none).count() == 0
    by_id = {r.doc_id: r for r in got if r.doc_id}
    assert {by_id[i].class_id for i in (1, 2, 3, 4)} == {1} and by_id[1].n_links == 4 and by_id[4].n_texts == 1
    assert by_id[5].n_links == by_id[7].n_links == 0 and by_id[6].class_id == 6


def test_jaccard_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    sets = {}
    for r in docs.collect():
        w = words(r.text.lower())
        sets[r.doc_id] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    expected = {a: sum(bool(x) and a != b and len(x & y) >= 0.8 * len(x | y) for b, y in sets.items()) for a, x in sets.items()}
    assert {r.doc_id: r.n_links for r in jaccard.join(docs).collect()} == expected


def test_tokens(spark, odd, none):
    from sentencepiece import SentencePieceProcessor

    got = tokenise.encode(odd).collect()
    sp = SentencePieceProcessor(model_file=tokenise.MODEL)
    assert len(got) == 13 and all(list(r.ids) == sp.encode(r.text or "") for r in got) and all(r.round_trip for r in got)
    assert tokenise.encode(none).count() == 0
    back = tokenise.decode(tokenise.encode(odd)).collect()
    assert all(r.decoded == (r.text or "") for r in back)


def test_contamination(spark, odd, none):
    items = spark.createDataFrame([(1, BASE), (2, "too few words"), (3, None), (None, BASE), (1, BASE)], "item_id long, text string")
    got = contamination.contaminated(odd, items).collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "2", "2", "3", "4", "None"] and {r.item_id for r in got} == {1}
    assert contamination.clean(odd, items).count() == 7 and contamination.clean(odd, items.limit(0)).count() == 13
    assert contamination.contaminated(none, items).count() == 0


def test_contamination_with_edits(spark):
    w = [f"w{k}" for k in range(60)]
    noisy = w[:30] + ["other"] + w[31:]
    far = [x if k % 4 else "zz" for k, x in enumerate(w)]
    docs = spark.createDataFrame([(1, "lead " * 9 + " ".join(noisy) + " tail" * 9), (2, " ".join(far))], "doc_id long, text string")
    got = contamination.contaminated(docs, spark.createDataFrame([(1, " ".join(w))], "item_id long, text string")).collect()
    assert [(r.doc_id, r.first_word, r.last_word) for r in got] == [(1, 9, 68)] and got[0].similarity == pytest.approx(51 / 56)


def test_contamination_of_rewritten_long_items(spark):
    rng, docs, items = np.random.default_rng(3), [], []
    for k in range(400):
        w = [f"i{k}x{j}" for j in range(150)]
        at = int(rng.integers(30, 90))
        # 150 words hold 146 shingles; 25 rewritten words take 29 of them
        docs.append((k, " ".join([*w[:at], *(f"r{k}y{j}" for j in range(25)), *w[at + 25 :]])))
        items.append((k, " ".join(w)))
    got = contamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(k, k) for k in range(400)]
    assert all(r.similarity == pytest.approx(117 / 146) for r in got)


def test_several_benchmark_slices_agree(spark):
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet").select(c, "text") for t, c in (("documents", "doc_id"), ("benchmark", "item_id")))
    whole = set(map(tuple, contamination.contaminated(docs, items).select("doc_id", "item_id").collect()))
    cut = set(map(tuple, contamination.contaminated(docs, items, contamination.Settings(most_items=15)).select("doc_id", "item_id").collect()))
    assert whole == cut and whole


def test_toxicity_learns_quotation(spark):
    """The same terms are abuse where plain, and none where labels show them clean between marks and reported."""
    filler = "the river ran past an old mill and the miller counted sacks of grain".split()

    def text(i, core):
        return " ".join(filler[(i + k) % 13] for k in range(12)) + f" {core} " + " ".join(filler[(3 * i + k) % 13] for k in range(8))

    def core(i, quoted):
        term = ("grobblenuts", "snarfwit", "vexolard")[i % 3]
        return f'he wrote the word "{term}" again' if quoted else f"you are a {term} again"

    rows = [(i, text(i, core(i, False)), 1) for i in range(150)]
    rows += [(i, text(i, core(i, True)), 0) for i in range(150, 200)] + [(i, text(i, "in the spring"), 0) for i in range(200, 1400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    scored = toxicity.score(docs, toxicity.fit(docs.select("doc_id", "text"), docs.select("doc_id", "toxic")))
    held = scored.where(toxicity.held_out(5)).collect()
    assert len([r for r in held if 150 <= r.doc_id < 200]) >= 5
    assert [r.doc_id for r in held if r.predicted != r.toxic] == []
    assert {h.quotation > 0.5 for r in held if r.toxic == 0 for h in r.hits} == {True}


def test_toxicity(spark, odd, none):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs.select("doc_id", "text"), labels)
    got = toxicity.score(odd, model).collect()
    assert len(got) == 13 and all(0 <= r.score <= 1 for r in got) and toxicity.score(none, model).count() == 0
    own = spark.createDataFrame([(1, "the thing is a stup1d worthles idiot"), (2, "the thing is on the other of it")], "doc_id long, text string")
    abuse, clean = toxicity.score(own, model).orderBy("doc_id").collect()
    assert abuse.score > 0.5 > clean.score and {h.edits for h in abuse.hits} == {0, 1}
    scored = toxicity.score(docs.select("doc_id", "text"), model).join(labels, "doc_id").where("toxic is not null").select("doc_id", "predicted", "toxic").toPandas()
    held = scored[[zlib.crc32(str(i).encode()) % 5 == 0 for i in scored.doc_id]]
    assert (held.predicted == held.toxic).mean() > 0.9


def test_levenshtein_automaton_is_the_edit_distance():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
        return row[-1]

    rng, terms = np.random.default_rng(4), ["abcab", "bcabcabca", "aabb", "cabcaabbc"]
    lexicon = toxicity.Lexicon(terms)
    for _ in range(3000):
        w = "".join(rng.choice(list("abc"), rng.integers(0, 12)))
        near = [(distance(w, t), k) for k, t in enumerate(terms) if distance(w, t) <= toxicity.edits_for(t)]
        assert lexicon.find(w) == min(near, default=None)


def test_lines(spark, none):
    long = "the quick brown fox jumps over the lazy dog and runs away from the very old house at night"
    rows = [(1, f"{long}\nalone"), (2, f"first\n\n{long.replace('old', 'odd')}\n  alone"), (3, None), (4, ""), (None, "only here"), (5, long), (5, long)]
    got = lines.dedup(spark.createDataFrame([(i, t, "r", 1) for i, t in rows], "doc_id long, text string, row2 string, n_lines int")).collect()
    kept = sorted((str(r.doc_id), str(r.text), r.n_lines, r.n_dropped) for r in got)
    assert kept == sorted([("1", f"{long}\nalone", 2, 0), ("2", "first\n", 3, 2), ("3", "None", 0, 0), ("4", "", 0, 0), ("None", "only here", 1, 0), ("5", "", 1, 1), ("5", "", 1, 1)])
    assert lines.dedup(none.select("doc_id", "text")).count() == 0


def shingle_set(x):
    return {x[k : k + 8] for k in range(max(1, len(x) - 7))}


def near(x, y):
    return len(x & y) >= 0.8 * len(x | y)


def components_of(n, links):
    """The smallest member of each one's component."""
    root = list(range(n))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(k) for k in range(n)]


def line_chains(rng, chains, steps, size=100):
    """Lines in chains: each is like the one before, those two apart mostly aren't."""
    out, letters = [], list("abcdefghijklmnopqrstuvwxyz ")
    for _ in range(chains):
        x = ["q", *rng.choice(letters, size - 2), "q"]
        for k in range(steps):
            out.append("".join(x))
            x[10 + 12 * k % 80] = "Z"
            x = x[:]
    return out


def test_lines_of_a_hot_key_by_brute_force(spark, monkeypatch):
    from pyspark.sql import functions as F

    # one key for all lines, so that candidates are all pairs
    monkeypatch.setattr(lines, "signatures", lambda each, s: each.select("lid", F.array(*[F.lit(1).cast("long")] * s.bands).alias("keys")))
    texts = line_chains(np.random.default_rng(5), 12, 6)
    sets = [shingle_set(x) for x in texts]
    links = [(a, b) for a in range(len(sets)) for b in range(a) if near(sets[a], sets[b])]
    assert len(links) == 60  # the chains A-B-C-D-E-F and nothing else
    expected = components_of(len(texts), links)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = lines.dedup(docs, lines.Settings(block=7)).collect()
    assert sorted(r.doc_id for r in got if not r.n_dropped) == sorted(set(expected))


@pytest.mark.parametrize("n", [6, 40, 150])
def test_near_lines_meet_in_a_band(spark, n):
    from pyspark.sql import functions as F

    rng, pairs = np.random.default_rng(n), []
    vocabulary = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(2, 9))) for _ in range(2000)]
    while len(pairs) < 400:
        a = " ".join(rng.choice(vocabulary, n))
        b, x, y = list(a), shingle_set(a), shingle_set(a)
        while len(x & y) >= 0.86 * len(x | y):
            b[rng.integers(0, len(b))] = "#"
            y = shingle_set("".join(b))
        if near(x, y):
            pairs.append((a, "".join(b)))
    df = spark.createDataFrame([(2 * k + side, x) for k, pair in enumerate(pairs) for side, x in enumerate(pair)], "lid long, line string")
    s = lines.Settings()
    keys = lines.signatures(df, s)
    one, two = (keys.where(F.col("lid") % 2 == side).select((F.col("lid") - side).alias("lid"), F.col("keys").alias(f"k{side}")) for side in (0, 1))
    meet = F.reduce(F.zip_with("k0", "k1", lambda x, y: x == y), F.lit(False), lambda x, y: x | y)
    met = one.join(two, "lid").where(meet).count()
    assert met >= 0.975 * 400


def test_pages(spark):
    page = "<html><body><nav><a href=x>Menu</a></nav><div class='cookie-notice'>Cookies, ok?</div><article><h1>A &amp; B</h1><p>One,  <b>two</b>\n three.<p>Four<br>five.<div class=comments><p>Nice, really!</p></div></article><footer>c</footer><script>x<y</script></body></html>"
    df = spark.createDataFrame([(1, "u", page), (2, "u", None), (3, "u", ""), (4, None, "<p>"), (5, "u", "plain words")], "page_id long, url string, html string")
    got = {r.page_id: r for r in extraction.extract(df).collect()}
    assert got[1].text == "A & B\nOne, two three.\nFour five." and got[1].n_chars == 32
    assert got[2].text == got[3].text == got[4].text == "" and got[5].text == "plain words"
    assert extraction.extract(df.limit(0)).count() == 0


def test_pages_judge_blocks_by_all_their_text():
    items = "".join(f"<li><a href=x>Name {k}</a> a long description of the thing, number {k}.</li>" for k in range(4))
    menu = "".join(f"<li><a href=x>Link {k}</a></li>" for k in range(4))
    page = f"<body><div class='no-sidebar'><article><p><span class=notice>Note</span> the whole paragraph is here, to be kept.</p><ul>{items}</ul><ul>{menu}</ul></article></div><div class=sidebar><p>Aside, short.</p></div></body>"
    got = extraction.main_text(page).split("\n")
    assert got == ["Note the whole paragraph is here, to be kept.", *(f"Name {k} a long description of the thing, number {k}." for k in range(4)), *(f"Link {k}" for k in range(4))]


SOUP = (
    "<body><div class=top><a href=x>Home</a> <a href=y>Shop</a> Wares and more for you and yours, today</div>"
    + "<div class=box>" + "".join(f"<span class=k{k}>Offer {k} now</span><div></div>" for k in range(4)) + "</div>"
    + "<div class=text><h1>The title</h1><p>A long first paragraph, with commas, and a full stop at its end.</p><p>Short.</p><p>And a third paragraph, which is long enough, too; it has a semicolon.</p></div>"
    + "<div class=end>Imprint Terms Privacy</div></body>"
)


def test_ratios_decide_where_no_tag_does(monkeypatch):
    expected = ["The title", "A long first paragraph, with commas, and a full stop at its end.", "Short.", "And a third paragraph, which is long enough, too; it has a semicolon."]
    assert extraction.main_text(SOUP).split("\n") == expected
    monkeypatch.setattr(extraction, "_scores", lambda page: {k: 1.0 for k in page.order if not page.bad[k]})
    assert extraction.main_text(SOUP).split("\n") != expected


def test_links_in_an_article_stay():
    page = "<article><p>Three books are named here, with their places.</p><ul>" + "".join(f"<li><a href=x>Book {k}</a></li>" for k in range(3)) + "</ul></article>"
    assert extraction.main_text(page).split("\n")[1:] == ["Book 0", "Book 1", "Book 2"]


def test_pages_without_article(spark):
    rows = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    same = [extraction.main_text(x) == extraction.main_text(re.sub(r"<(/?)(article|main)\b", r"<\1div", x or "")) for x in rows]
    assert sum(same) >= 0.98 * len(same)


def test_gumbel_draws_by_the_weights(spark):
    """Of two documents, the one of weight w comes before the other with probability e^w / (e^w + e^v)."""
    text = ["aaaa", "abab"]
    docs = spark.createDataFrame([(2 * k + side, text[side]) for k in range(4000) for side in (0, 1)], "doc_id long, text string")
    s = quality.Settings()
    ratio = np.random.default_rng(3).normal(0, 0.4, s.size)
    got = quality.weights(docs, quality.Model(ratio, 0.0), s).toPandas()
    w = got.groupby(got.doc_id % 2).weight.first()
    expected = 1 / (1 + math.exp(w[1] - w[0]))
    first = got[got.doc_id % 2 == 0].sort_values("doc_id").key.to_numpy() > got[got.doc_id % 2 == 1].sort_values("doc_id").key.to_numpy()
    assert abs(first.mean() - expected) < 4 * math.sqrt(expected * (1 - expected) / 4000) + 1e-9


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "all rights reserved", "<p>x y.</p>", 1, 2, 3, 4)], "doc_id long, text string, html string, scanned int, extracted_from int, noise int, row__ int")
    assert licences.scan(df).first().scanned == 1 and extraction.extract(df).first().extracted_from == 2
    assert quality.weights(df, quality.Model(np.zeros(quality.Settings().size), 0.0), quality.Settings()).first().noise == 3
    got = scoring.score(df, "true", scoring.Settings(rounds=1, steps=5, most_head=50)).first()
    assert got.row__ == 4 and got.n_tokens == 4


def test_quality_held_out(spark):
    from pyspark.sql import functions as F

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = quality.fit(docs, labels.where(~out))
    got = quality.weights(docs, model, quality.Settings()).join(labels.where(out), "doc_id").toPandas()
    assert len(got) > 30 and (got.keep == (got.quality == 1)).mean() > 0.97


def test_quality(spark, odd, none):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    s = quality.Settings()
    model = quality.fit(docs, labels, s)
    got = quality.weights(docs.select("doc_id", "text"), model, s).join(labels, "doc_id").toPandas()
    assert (got.keep == (got.quality == 1)).mean() > 0.97
    assert quality.weights(odd, model, s).count() == 13 and quality.weights(none, model, s).count() == 0
    assert quality.weights(none, quality.fit(none, labels, s), s).count() == 0


def test_kth_largest(spark):
    x = [float(v) for v in np.random.default_rng(0).normal(size=5000)] + [1.5] * 500
    df = spark.createDataFrame([(v,) for v in x], "key double")
    for k in (1, 17, 600, 5500):
        assert quality.kth_largest(df, "key", k, most=50) == sorted(x, reverse=True)[k - 1]


def test_scoring(spark, odd, none):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(odd.select("doc_id", "text").where("doc_id is not null"))
    got = scoring.score(docs, "crc32(cast(doc_id as string)) % 7 <> 2", scoring.Settings(rounds=1, steps=60, most_head=500)).collect()
    texts = [(r.doc_id, re.findall("[^\x20\x09-\x0d]+", (r.text or "").translate(LOW)) + [None]) for r in docs.collect()]
    c = collections.Counter(w for i, t in texts if zlib.crc32(str(i).encode()) % 7 != 2 for w in t)
    n, v = sum(c.values()), len(c)
    expected = sorted((i, len(t), sum(c[w] > 0 for w in t), round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), 4)) for i, t in texts)
    assert sorted((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 4)) for r in got) == expected
    assert all(r.train_tokens == n for r in got) and sum(r.score for r in got) > sum(r.base_score for r in got)
    assert scoring.score(none, "true", scoring.Settings(rounds=1, steps=5)).count() == 0


def test_bilinear_is_normalised():
    s = scoring.Settings(classes=16, own_class=10, width=5)
    table = scoring.Bilinear(s).start(np.full(16, 1 / 16)).log10_table().reshape(256, 16)
    assert (10**table).sum(1) == pytest.approx(np.ones(256))


def test_components(spark):
    edges = [(1, 2), (2, 3), (10, 11), (11, 12), (12, 10), (5, 5), *((100 + k, 101 + k) for k in range(40))]
    got = dict(map(tuple, shared.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {1: 1, 2: 1, 3: 1, 10: 10, 11: 10, 12: 10} | {100 + k: 100 for k in range(41)}


def test_pipeline(spark):
    import corpus_pipeline

    got = corpus_pipeline.run(spark, SF)
    assert got.columns == ["doc_id", "ids", "n_tokens", "round_trip"]
    rows = got.collect()
    assert len(rows) > 50 and len({r.doc_id for r in rows}) == len(rows) and all(r.round_trip for r in rows)


@pytest.mark.parametrize("own", [30, 60])
def test_lines_that_quote_one_passage_do_not_meet(spark, own):
    rng, letters = np.random.default_rng(own), list("abcdefghijklmnopqrstuvwxyz ")
    passage = "".join(rng.choice(letters, 300))
    texts = [passage + "".join(rng.choice(letters, own)) for _ in range(120)]
    texts += [x[:250] + "Z" + x[251:] for x in texts[:5]]
    sets = [shingle_set(x) for x in texts]
    linked = [(a, b) for b in range(len(sets)) for a in range(b) if near(sets[a], sets[b])]
    each = spark.createDataFrame(list(enumerate(texts)), "lid long, line string")
    compared = spark.createDataFrame([(0, k, False) for k in range(1, len(texts))], "head long, lid long, alike boolean")
    alone = spark.createDataFrame([], "vertex long, component long")
    met = {(r.a, r.b) for r in lines.across_classes(compared, alone, each, lines.Settings()).collect()}
    tied = components_of(len(texts), [p for p in met if near(sets[p[0]], sets[p[1]])])
    assert tied == components_of(len(texts), [(a, b) for a, b in linked if a])
    assert len(met) < 2 * len(texts)


@pytest.mark.parametrize("n", [25, 150])
def test_copies_edited_in_different_words_are_told_apart_before_they_are_verified(spark, n):
    rng, letters = np.random.default_rng(n), list("abcdefghijklmnopqrstuvwxyz")
    text = ["".join(rng.choice(letters, 6)) for _ in range(60)]
    texts, word = [" ".join(text)], lambda: "".join(rng.choice(letters, 6))
    for _ in range(n):
        edits = set(rng.choice(60, rng.integers(4, 9), replace=False))
        texts.append(" ".join(word() if k in edits else x for k, x in enumerate(text)))
    texts += [x.replace(x.split()[-1], "odd") for x in texts[1:6]]
    sets = [shingle_set(x) for x in texts]
    linked = [(a, b) for b in range(len(sets)) for a in range(1, b) if near(sets[a], sets[b])]
    each = spark.createDataFrame(list(enumerate(texts)), "lid long, line string")
    compared = spark.createDataFrame([(0, k, False) for k in range(1, len(texts))], "head long, lid long, alike boolean")
    alone = spark.createDataFrame([], "vertex long, component long")
    met = {(r.a, r.b) for r in lines.across_classes(compared, alone, each, lines.Settings()).collect()}
    tied = components_of(len(texts), [p for p in met if near(sets[p[0]], sets[p[1]])])
    assert tied == components_of(len(texts), linked) and linked
    assert len(met) < 4 * len(linked)


def test_only_lines_of_large_heads_are_set_against_a_usual_text(spark, monkeypatch):
    texts, seen, whole = line_chains(np.random.default_rng(7), 12, 6), [], lines.apart

    def counted(pairs, each, s):
        seen.append({r.head for r in pairs.select("head").distinct().collect()})
        return whole(pairs, each, s)

    monkeypatch.setattr(lines, "apart", counted)
    # 30 lines have one head, 42 another
    n, sets = len(texts), [shingle_set(x) for x in texts]
    each = spark.createDataFrame([*enumerate(texts), (n, texts[0] + "head"), (n + 1, texts[40] + "head")], "lid long, line string")
    compared = spark.createDataFrame([(n + (k >= 30), k, False) for k in range(n)], "head long, lid long, alike boolean")
    alone = spark.createDataFrame([], "vertex long, component long")
    met = {(r.a, r.b) for r in lines.across_classes(compared, alone, each, lines.Settings()).collect()}
    linked = [(a, b) for b in range(n) for a in range(b) if near(sets[a], sets[b])]
    tied = components_of(n, [p for p in met if near(sets[p[0]], sets[p[1]])])
    assert tied == components_of(n, linked) and len(linked) == 60
    assert seen == [{n + 1}]


def test_texts_meet_their_dropped_lines_unsorted(spark):
    docs = spark.createDataFrame([(k, f"line {k % 3} of several words\nanother line of a text {k}") for k in range(9)], "doc_id long, text string")
    plan = lines.dedup(docs)._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "BroadcastHashJoin" not in plan and "SortMergeJoin" not in plan
