"""Quality, segmentation, Jaccard join, page extraction, lines and decontamination."""

from __future__ import annotations

import collections
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from tontine.llm import components, decontam, jaccard, linededup, mainhtml, pieces, quality
from tontine.llm.arrowtools import mix64
from tontine.llm.words import WordHashes

TEXTS = "doc_id long, text string, source string, node long, score double"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, None, None, None)[:5] if len(r) == 2 else (*r, None, None)[:5] for r in rows], TEXTS).repartition(parts)


# quality


def crc_fold(key="doc_id"):
    return F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1


def test_quality_on_held_out_labels(spark):
    path = "/root/testdata/sf0.1"
    documents, labels = (spark.read.parquet(f"{path}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(documents, labels.filter(~crc_fold()))
    rows = quality.score(documents, model).withColumnRenamed("key", "doc_id").join(labels, "doc_id").filter(crc_fold()).collect()
    assert sum((r.score >= 0.5) == (r.quality == 1) for r in rows) / len(rows) > 0.97


def test_quality_equals_a_plain_loop_and_takes_odd_rows(spark, sf):
    documents, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(documents, labels)
    pair = quality.compressors(model)
    rows = [(1, None), (2, ""), (None, "word " * 2000), (4, "é" * 9000), (4, "é" * 9000), (5, "x")]
    got = quality.score(frame(spark, rows), model).collect()
    assert len(got) == 6
    texts = {1: "", 2: "", None: "word " * 2000, 4: "é" * 9000, 5: "x"}
    for r in got:
        want = quality.curve_value(model.curve, *quality.sizes(texts[r.key].encode(), *pair))
        assert r.score == pytest.approx(want) and 0 <= r.score <= 1
    kept = quality.keep(frame(spark, rows), model)
    assert kept.columns == TEXTS.replace(" long", "").replace(" string", "").replace(" double", "").split(", ")
    assert kept.count() == sum(r.score >= 0.5 for r in got)


def test_quality_without_labels(spark):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (3, 1)], "doc_id long, quality int")
    model = quality.train(frame(spark, [(1, "a"), (3, "b")]), labels)
    assert [round(r.score, 6) for r in quality.score(frame(spark, [(1, "a")]), model).collect()] == [round(2 / 3, 6)]
    assert quality.score(frame(spark, [(1, "a")]).limit(0), model).count() == 0


# segmentation


@pytest.fixture(scope="module")
def sampler():
    return pieces.Sampler(open(pieces.MODEL, "rb").read(), 3)


def all_segmentations(vocabulary, word):
    if not word:
        return [((), 0.0)]
    out = []
    for j in range(1, len(word) + 1):
        if word[:j] in vocabulary.pieces:
            i, weight = vocabulary.pieces[word[:j]]
            out += [((i, *rest), weight + log) for rest, log in all_segmentations(vocabulary, word[j:])]
    return out


def test_samples_follow_the_law_of_draws_without_replacement(sampler):
    found = all_segmentations(sampler.vocabulary, "▁thond")
    total = math.log(sum(math.exp(w) for _, w in found))
    chance = {ids: math.exp(w - total) for ids, w in found}
    n = 4000
    paths, alive, _ = sampler.draw(["thond"] * n, mix64(np.arange(n, dtype=np.uint64)))
    first = collections.Counter(tuple(sampler.ids(paths[0], r).tolist()) for r in range(n))
    second = collections.Counter(tuple(sampler.ids(paths[1], r).tolist()) for r in range(n))
    for ids, p in chance.items():
        q = sum(other * p / (1 - other) for key, other in chance.items() if key != ids)
        assert abs(first[ids] / n - p) < 4 * math.sqrt(p / n) + 2 / n
        assert abs(second[ids] / n - q) < 4 * math.sqrt(q / n) + 2 / n
    for r in range(50):
        assert len({tuple(sampler.ids(path, r).tolist()) for path in paths}) == 3
        assert paths[0].value[r] > paths[1].value[r] > paths[2].value[r]
        for path in paths:
            assert math.exp(path.total[r]) == pytest.approx(chance[tuple(sampler.ids(path, r).tolist())])


def test_encoding_decodes_and_repeats(spark):
    rows = [(1, "Hello  world\n\té ß 漢字😀 x"), (2, ""), (3, None), (None, "a"), (5, " lead trail "), (6, "q" * 3000), (6, "q" * 3000)]
    got = pieces.encode(frame(spark, rows)).collect()
    assert all(r.decodes for r in got)
    again = {(r.doc_id, r["sample"]): r.pieces for r in pieces.encode(frame(spark, rows, 1)).collect()}
    assert all(again[r.doc_id, r["sample"]] == r.pieces for r in got)
    counts = collections.Counter(r.doc_id for r in got)
    assert counts[1] == 2 and counts[2] == 1 and counts[3] == 1 and counts[6] == 4
    assert {r.doc_id: r.log_inclusion for r in got if not r.n_pieces} == {2: 0.0, 3: 0.0}
    texts = {r.doc_id: r.text for r in pieces.decode(pieces.encode(frame(spark, rows))).collect()}
    assert texts[1] == rows[0][1] and texts[5] == " lead trail " and texts[2] == ""
    processor = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    assert all(processor.decode(list(r.pieces)) == "Hello  world\n\té ß 漢字😀 x" for r in got if r.doc_id == 1)
    assert pieces.encode(frame(spark, rows).limit(0)).count() == 0


# Jaccard join


def sets_by_hand(rows):
    out = []
    for _, text in rows:
        w = WORD.findall((text or "").translate(LOWER))
        out.append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    return out


def components_by_hand(rows):
    sets, parent = sets_by_hand(rows), list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                parent[root(i)] = root(j)
    groups = collections.defaultdict(list)
    for i in range(len(rows)):
        groups[root(i)].append(rows[i][0])
    least = {k: min((x for x in v if x is not None), default=None) for k, v in groups.items()}
    return sorted(((r[0], len(sets[i]), r[0] if not sets[i] else least[root(i)]) for i, r in enumerate(rows)), key=str)


def near_copies(seed, n, words, share):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    base = [rng.choice(vocabulary) for _ in range(words)]
    out = []
    for _ in range(n):
        copy = list(base)
        for _ in range(rng.randint(0, int(words * share))):
            copy[rng.randrange(words)] = f"v{rng.randrange(10**6)}"
        out.append(" ".join(copy))
    return out


@pytest.mark.parametrize(("share", "often"), [(1 / 500, 24), (0.9, 1000), (0.9, 4)])
def test_jaccard_equals_brute_force(spark, share, often):
    rows = [(100 + i, t) for i, t in enumerate(near_copies(1, 60, 80, 0.06) + near_copies(2, 25, 20, 0.1) + near_copies(3, 25, 9, 0.15))]
    rows += [(300 + i, " ".join(t.split()[: 60 + i])) for i, t in enumerate(near_copies(1, 20, 80, 0.02))]
    rows += [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "One TWO"), (6, "one\x0btwo"), (7, "one\xa0two"), (8, "É é a b c d")]
    rows += [(None, rows[0][1]), (None, "alone in the world of null ids"), (9, rows[0][1]), (9, rows[0][1]), (9, "other text of the same id here")]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.cluster(frame(spark, rows), share=share, often=often).collect()), key=str)
    assert got == components_by_hand(rows)


def test_band_overlaps_and_classes_agree():
    none = np.empty(0, np.int64)
    prefixes = jaccard.Prefixes(75, jaccard.Frequent(none.view(np.uint64), none, none, none))
    for a in range(40):
        for b in range(40):
            assert prefixes.classes(a, b) == prefixes.classes(b, a)


@pytest.mark.parametrize("frequent", [0.0, 0.5, 1.0])
def test_linked_sets_share_a_key(frequent):
    """Every linked pair of random sets meets under a key whose sides allow it, whatever is called frequent."""
    rng = np.random.default_rng(8)
    for _ in range(150):
        n = int(rng.integers(1, 200))
        x = np.unique(mix64(rng.integers(0, 1 << 60, n).astype(np.uint64)))
        drop = int(rng.integers(0, max(1, len(x) // 7) + 1))
        fresh = np.unique(mix64(rng.integers(0, 1 << 60, int(rng.integers(0, max(1, len(x) // 8) + 1))).astype(np.uint64)))
        y = np.unique(np.concatenate((rng.permutation(x)[drop:], fresh)))
        shared = len(np.intersect1d(x, y))
        if not len(y) or 100 * shared < 75 * (len(x) + len(y) - shared):
            continue
        universe = np.unique(np.concatenate((x, y)))
        often = np.sort(rng.permutation(universe)[: int(frequent * len(universe))])
        tops = np.unique(jaccard.tops_of(np.sort(rng.permutation(universe)[: len(universe) // 3])))
        prefixes = jaccard.Prefixes(75, jaccard.Frequent(often, rng.permutation(len(often)) + 1, tops, rng.permutation(len(tops)) + 1))
        (kx, sx, _), (ky, sy, _) = prefixes.keys(x), prefixes.keys(y)
        sides = collections.defaultdict(set)
        for key, side in zip(kx.tolist(), sx.tolist()):
            sides[key].add(side)
        assert any(s == -1 or any(t != s for t in sides[k]) for k, s in zip(ky.tolist(), sy.tolist()) if k in sides)


def test_sketch_never_drops_a_link():
    rng = np.random.default_rng(4)
    for _ in range(200):
        x = np.unique(mix64(rng.integers(0, 1 << 60, int(rng.integers(1, 900))).astype(np.uint64)))
        y = np.unique(np.concatenate((rng.permutation(x)[len(x) // 9 :], mix64(rng.integers(0, 1 << 60, len(x) // 9).astype(np.uint64)))))
        shared = len(np.intersect1d(x, y))
        if 100 * shared >= 75 * (len(x) + len(y) - shared):
            assert jaccard.may_link(jaccard.sketch(x), jaccard.sketch(y), len(x), len(y), 75)


def test_keep_one_and_empty(spark):
    rows = [(5, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (9, "z y x w v u"), (None, "q"), (4, "")]
    docs = frame(spark, rows)
    assert sorted(str(r.doc_id) for r in jaccard.keep_one(docs, jaccard.cluster(docs)).collect()) == ["3", "4", "9", "None"]
    assert jaccard.cluster(docs.limit(0)).count() == 0


def test_components_of_a_chain(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7), (102, 100)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and {got[100], got[101], got[102]} == {100}


# pages


def test_main_text():
    costs = mainhtml.DEFAULT_COSTS
    page = (
        "<html><head><title>T</title><style>p{}</style><script>var a='</p>';</script></head><body><header><a href=/>Home</a></header>"
        "<nav><ul><li><a>One</a></ul></nav><div class='cookie-banner'>We use cookies</div><article><h1>Head &amp; shoulders</h1>"
        "<p>First <b>bold</b>\n block&nbsp;text.<p class=ad>Buy!<p>Second <a href='x>y'>link</a>.<aside>side</aside><!-- no <p>x</p> -->"
        "<form><input>go</form><p>Third &lt;tag&gt;.</p><section id=comments><p>Nice!</p></section></article>"
        "<div class='has-sidebar'>outside words that are many, many more than one would think of here</div><footer>&copy;</footer>"
    )
    assert mainhtml.main_text(page, costs) == "Head & shoulders First bold block text. Second link. Third <tag>."
    assert mainhtml.main_text(None, costs) == mainhtml.main_text("", costs) == mainhtml.main_text("<p></p>", costs) == ""
    assert mainhtml.main_text("no markup at all", costs) == "no markup at all"
    assert mainhtml.main_text("<p>" + "w " * 100000, costs) == ("w " * 100000).strip()
    assert mainhtml.main_text("<div class=ad>only marked words</div>", costs) == "only marked words"
    assert mainhtml.main_text("<p>a < b <i>and</i> c &gt; d <a title=\"x>bar", costs) == "a < b and c > d"


@pytest.mark.parametrize("mark", ["discussion", "search-algorithms", "related-work", "shareholders", "commentary", "social-policy"])
def test_article_parts_named_by_their_subject_stay(mark):
    costs = mainhtml.DEFAULT_COSTS
    page = f"<body><article><p>It is begun here.</p><h2 id={mark}>Title of some words</h2><section id='{mark}'><p>Text of it.</p></section><p>More.</p></article></body>"
    assert mainhtml.main_text(page, costs) == "It is begun here. Title of some words Text of it. More."
    assert mainhtml.main_text(page.replace("article>", "div>"), costs) == "It is begun here. Title of some words Text of it. More."
    assert mainhtml.main_text(f"<article><p>One.</p><div class='{mark}'><p>Two.</p></div></article>", costs) == "One. Two."


def test_marked_and_hidden_parts_of_an_article_go():
    costs = mainhtml.DEFAULT_COSTS
    for part in ("class='x related-posts'", "id=comments", "class=ad", "role=complementary", "class=share-buttons", "hidden", "hidden=''",
                 "style='color:red; display: none'", "aria-hidden=true"):
        assert mainhtml.main_text(f"<article><p>One.</p><div {part}><p>Two.</p></div><p>Three.</p></article>", costs) == "One. Three."
    for part in ("title='A hidden valley'", "data-note='display: none'", "alt='hidden'", "aria-label='Discussion of comments'"):
        assert mainhtml.main_text(f"<article><p>One.</p><div {part}><p>Two.</p></div></article>", costs) == "One. Two."


def test_form_around_the_page():
    costs = mainhtml.DEFAULT_COSTS
    text = " ".join(f"word{i}" for i in range(40))
    for inner in (f"<article><p>{text}</p></article>", f"<div><p>{text}</p></div>"):
        page = f"<body><form id=form1 action='/go'><input>{inner}</form><footer>end of page</footer></body>"
        assert mainhtml.main_text(page, costs) == text
    assert mainhtml.main_text(f"<body><p>{text}</p><form><p>Your name</p></form></body>", costs) == text


def test_pages_of_the_table(spark, sf):
    """On pages with one article the text is what that element holds."""
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    costs = mainhtml.learn(pages)
    html = {r.page_id: r.html for r in pages.collect()}
    import html as references

    for r in mainhtml.extract(pages, costs).collect():
        inner = re.search(r"<article>(.*)</article>", html[r.page_id], re.S).group(1)
        inner = re.sub(r"<[^>]*>", " ", re.sub(r"<(?!/?(?:p|h1|br)\b)[^>]*>", "", inner))
        assert r.text == " ".join(references.unescape(inner).split()) and r.n_chars == len(r.text)


def test_odd_pages(spark):
    schema = "page_id long, url string, html string, text string, n_chars int"
    rows = [(None, None, None, "t", 1), (1, "u", "", "t", 1), (1, "u", "<p>x</p>", "t", 1), (1, "u", "<p>x</p>", "t", 1)]
    df = spark.createDataFrame(rows, schema)
    assert sorted(r.text for r in mainhtml.extract(df, mainhtml.learn(df)).collect()) == ["", "", "x", "x"]
    assert mainhtml.learn(df.limit(0)) == mainhtml.DEFAULT_COSTS and mainhtml.extract(df.limit(0), {}).count() == 0


# lines


def test_boilerplate_lines(spark):
    rows = [(i, f"menu\nbody {i}\n\n  menu\r\nend {i}", "a") for i in range(20)]
    rows += [(100 + i, "copied text\nof one page", "a") for i in range(30)]  # copies count as one page
    rows += [(200, "menu\nrare", "b"), (201, None, "a"), (202, "", "a"), (203, "menu", None), (204, "menu", "a"), (204, "menu", "a")]
    got = collections.defaultdict(list)
    for r in linededup.clean(frame(spark, rows)).collect():
        got[r.doc_id].append((r.text, r.dropped_lines))
    assert got[3] == [("body 3\n\nend 3", 2)] and got[101] == [("copied text\nof one page", 0)]
    assert got[200] == [("menu\nrare", 0)] and got[201] == [(None, 0)] and got[202] == [("", 0)] and got[203] == [("menu", 0)]
    assert got[204] == [("", 1)] * 2
    assert linededup.clean(frame(spark, rows).limit(0)).count() == 0


# decontamination


def words_of(text):
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", (text or "").translate(LOWER))


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def leaks_by_hand(texts, items):
    out = {}
    for r, text in enumerate(texts):
        w = words_of(text)
        for i, item in items:
            v = words_of(item)
            n = len(v)
            k = int(n * decontam.EDIT_SHARE + 1e-9)
            if n >= decontam.LEAST_WORDS:
                held = set(v)  # a window within k edits holds n - k words of the item
                near = [s for s in range(len(w)) if sum(x in held for x in w[s : s + n]) >= n - k]
                best = min((distance(w[s : s + n], v) for s in near), default=n)
                if best <= k:
                    out[r, i] = best
    return out


def planted(seed, n_items=6, copies=8):
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in "the of and in on er".split() for b in "ing tion ly an st the".split()]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(8, 40)))) for i in range(n_items)]
    texts = []
    for _, item in items * copies:
        v = item.split()
        for _ in range(rng.randint(0, int(len(v) * decontam.EDIT_SHARE))):
            p = rng.randrange(len(v))
            v[p : p + 1] = rng.choice([["zz"], ["zz", v[p]], []])
        side = [rng.choice(vocabulary) for _ in range(rng.randint(0, 25))]
        texts.append(" ".join(side + v + side[::-1]))
    return items, texts


def test_leaks_are_found_and_measured_right():
    items, texts = planted(5)
    block = decontam.build_items([i for i, _ in items], [t for _, t in items])
    found = {(r, int(block.ids[o])): e for r, o, e, _ in decontam.find(block, pa.array(texts), WordHashes(punctuation=True))}
    want = leaks_by_hand(texts, items)
    assert set(found) <= set(want) and all(want[p] <= e for p, e in found.items())
    assert len(found) >= 0.95 * len(want) and len(want) > 30


@pytest.mark.parametrize("stutter", ["x x x x x x y z", "0 0 0 0 0 0 0 0", "q q q q q p p p"])
def test_leaks_beside_items_of_a_repeated_word(stutter):
    plain = "alpha beta gamma delta epsilon zeta eta theta"
    items = [(0, stutter), (1, plain), (2, " ".join(f"w{i}" for i in range(8)))]
    repeated = stutter.split()[0]
    texts = [plain, f"{repeated} " * 60 + stutter, "near " + plain.replace("beta", "other") + " end", f"{repeated} " * 3]
    texts += ["w0 w1 " * 20 + plain, " ".join(f"w{i}" for i in range(8)), "only filler here", stutter, plain + " tail"] * 3
    block = decontam.build_items([i for i, _ in items], [t for _, t in items])
    found = {(r, int(block.ids[o])): e for r, o, e, _ in decontam.find(block, pa.array(texts), WordHashes(punctuation=True))}
    assert found == leaks_by_hand(texts, items)


def test_leaks_of_odd_rows(spark):
    items, texts = planted(6, 4, 1)
    passage = items[0][1]
    rows = [(1, passage), (2, passage.upper().replace(" ", ", ")), (3, None), (4, ""), (None, "before " + passage), (6, "the " * 3000)]
    rows += [(7, passage), (7, passage), (8, " ".join(passage.split()[:-1])), (9, "x " * 50 + passage)]
    benchmark = spark.createDataFrame([*items, (50, None), (51, ""), (52, "too short"), (None, passage), (0, passage)], "item_id long, text string")
    docs = frame(spark, rows)
    got = collections.Counter((r.doc_id, r.item_id) for r in decontam.leaks(docs, benchmark).collect())
    assert got[1, 0] == 2 and got[2, 0] == 2 and got[None, 0] == 2 and got[7, 0] == 4 and got[9, 0] == 2 and got[8, 0] == 2
    assert not {d for d, _ in got} & {3, 4, 6}
    assert {r.doc_id for r in decontam.keep_clean(docs, benchmark).collect()} == {3, 4, 6}
    assert decontam.keep_clean(docs, benchmark).columns == docs.columns
    assert decontam.leaks(docs, benchmark.limit(0)).count() == 0 and decontam.keep_clean(docs, benchmark.limit(0)).count() == len(rows)
    assert decontam.leaks(docs.limit(0), benchmark).count() == 0
