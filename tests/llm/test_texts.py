"""Contamination, mixing and residue."""

import random
import re

import pytest

from vicinage.llm.contamination import BLOCK, Limits, leaked_items, leaked_passages
from vicinage.llm.residue import find_residue, residue_of, without_residue
from vicinage.llm.source_mix import TOKENIZER, _encoding, _pieces, expected_copies, mix_sources, mixing_plan, mixture_shares, poisson_rate, poisson_table

WORDS = [f"w{i}" for i in range(400)] + ["Straße", "naïve", "x1", "ÉTÉ"]


def tokens(text):
    return re.findall(r"[^\W_]+", text.lower())


def brute_leaks(docs, items, n=12):
    out = set()
    for d, text in docs:
        if d is None or text is None:
            continue
        t = tokens(text)
        grams = {tuple(t[i : i + n]) for i in range(len(t) - n + 1)}
        for k, item in items:
            w = tokens(item or "")
            if any(tuple(w[i : i + n]) in grams for i in range(len(w) - n + 1)):
                out.add((d, k))
    return out


def corpus():
    rng = random.Random(5)
    items = [(k, " ".join(rng.choices(WORDS, k=rng.choice([8, 12, 30, 60])))) for k in range(12)] + [(90, None), (91, ""), (92, "a " * 30)]
    docs = []
    for d in range(120):
        body = rng.choices(WORDS, k=rng.randrange(0, 200))
        if rng.random() < 0.6:
            w = (items[rng.randrange(12)][1]).split()
            size = rng.choice([11, 12, 13, 25])
            at = rng.randrange(0, max(1, len(w) - size + 1))
            part = w[at : at + size]
            if rng.random() < 0.3 and len(part) > 6:
                part[6] = "other"
            where = rng.randrange(0, len(body) + 1)
            body[where:where] = [rng.choice(["**{}**", "{},", "({})", "{}"]).format(x.upper() if rng.random() < 0.2 else x) for x in part]
        docs.append((d, rng.choice([" ", "\n", " — ", "_"]).join(body)))
    long = rng.choices(WORDS, k=BLOCK)
    docs += [(500, " ".join(long[: BLOCK - 5] + items[3][1].split() * 2 + long)), (501, None), (502, ""), (None, items[2][1]), (503, docs[1][1]), (503, docs[1][1]), (504, "a " * 13)]
    return docs, items


def frames(spark, docs, items):
    return spark.createDataFrame([(d, t, "clash", 1) for d, t in docs], "doc_id bigint, text string, item string, pos int"), spark.createDataFrame([(k, t, "s") for k, t in items], "item_id bigint, text string, doc string")


@pytest.mark.parametrize("limits", [Limits(), Limits(broadcast_seeds=0), Limits(table_slots=8)])
def test_leaks_against_brute_force(spark, limits):
    docs, items = corpus()
    passages = leaked_passages(*frames(spark, docs, items), limits=limits)
    got = {(r["doc_id"], r["item_id"]) for r in leaked_items(passages).collect()}
    assert got == brute_leaks(docs, items) and (504, 92) in got and any(d == 500 for d, _ in got)


def test_texts_that_repeat_themselves(spark):
    items = [(1, "same " * 4000), (2, "one two three " * 700), (3, " ".join(f"w{i}" for i in range(40)) + " same" * 20)]
    docs = [(1, "SAME " * 4000), (2, "two three one " * 900), (3, " ".join(f"w{i}" for i in range(5, 30)) + " x " + " ".join(f"w{i}" for i in range(5, 30)) + " same" * 12)]
    rows = leaked_passages(*frames(spark, docs, items)).collect()
    assert {(r["doc_id"], r["item_id"]) for r in rows if r["exact_words"] >= 12} == brute_leaks(docs, items)
    assert len(rows) == len({(r["doc_id"], r["item_id"]) for r in rows}) and max(r["alignments"] for r in rows) <= 30


def test_single_replaced_word_is_bridged(spark):
    item = [f"q{i}" for i in range(24)]
    for hole in (0, 5, 11, 12):
        part = list(item)
        part[hole] = "zzz"
        d, i = frames(spark, [(1, "lead " + " ".join(part) + " tail")], [(7, " ".join(item))])
        best = max(leaked_passages(d, i).collect(), key=lambda r: r["tolerant_words"])
        assert best["exact_words"] == max(hole, 23 - hole) and best["tolerant_words"] >= 18
        assert best["substitutions"] == (1 if 5 <= hole else 0)


def brute_stretch(equal, bridge):
    best = 0
    for i in range(len(equal)):
        for j in range(i, len(equal)):
            holes = [k for k in range(i, j + 1) if not equal[k]]
            if equal[i] and equal[j] and all(b - a > bridge for a, b in zip(holes, holes[1:])):
                best = max(best, j - i + 1)
    return best


def test_every_place_of_a_run_of_twelve_may_be_replaced(spark):
    item = [f"q{i}" for i in range(12)]
    docs = [(hole, " ".join(["lead", *item[:hole], "zzz", *item[hole + 1 :], "tail"])) for hole in range(12)]
    got = {r["doc_id"]: (r["tolerant_words"], r["substitutions"]) for r in leaked_passages(*frames(spark, docs, [(7, " ".join(item))])).collect()}
    # a stretch ends in equal words: at the edge, eleven are left
    assert got == {hole: (11, 0) if hole in (0, 11) else (12, 1) for hole in range(12)}


def test_tolerant_stretch_against_brute_force(spark):
    rng = random.Random(4)
    item = [f"q{i}" for i in range(60)]
    equal = [[i in range(20, 32) or rng.random() < 0.8 for i in range(60)] for _ in range(40)]
    docs = [(d, " ".join(w if e else "zzz" for w, e in zip(item, row))) for d, row in enumerate(equal)]
    got = {r["doc_id"]: r["tolerant_words"] for r in leaked_passages(*frames(spark, docs, [(7, " ".join(item))])).filter("shift = 0").collect()}
    assert got == {d: brute_stretch(row, 5) for d, row in enumerate(equal)}


def test_leaks_of_nothing(spark):
    d, i = frames(spark, [], [])
    assert leaked_passages(d, i).count() == 0


def test_pieces_keep_tokens():
    encode = _encoding(TOKENIZER).encode_ordinary
    rng = random.Random(8)
    text = "".join(rng.choice(["alpha beta ", "x\n\n  y", "don't stop", "  ", "12,5 ", "été-là "]) for _ in range(9000))
    assert "".join(_pieces(text)) == text and len(_pieces(text)) > 2
    assert sum(len(encode(p)) for p in _pieces(text)) == len(encode(text))


def test_plan():
    plan = mixing_plan({"a": 1000, "b": 100, "none": 0}, {"a": (0.5, 1), "b": (0.3, 4), "none": (0.2, 9), "absent": (0.0, 1)})
    assert set(plan) == {"a", "b"} and plan["b"]["mean_copies"] == 4.0 and plan["b"]["rate"] is None
    share = {s: p["planned_tokens"] for s, p in plan.items()}
    assert abs(share["a"] / (share["a"] + share["b"]) - 0.625) < 1e-9
    big = mixing_plan({"a": 1000, "b": 100}, {"a": (0.5, 1), "b": (0.5, 4)}, total=5000)
    assert big["a"]["mean_copies"] == 1.0 and big["b"]["mean_copies"] == 4.0
    for cap in (1, 3, 10):
        for mean in (0.01, 0.4, 0.99 * cap):
            assert abs(expected_copies(poisson_rate(mean, cap), cap) - mean) < 1e-6
    assert mixing_plan({}, {"a": (1.0, 1)}) == {}


def mixture_frames(spark):
    rng = random.Random(9)
    docs = [(i, " ".join(rng.choices(["alpha", "beta", "gamma"], k=rng.randrange(5, 60))), "big") for i in range(3000)]
    docs += [(10_000 + i, "delta epsilon " * rng.randrange(2, 20), "small") for i in range(200)] + [(1, None, "big"), (None, "x y", "big"), (77_777, "", "big"), (88_888, "lost", None), (99_999, "stray", "unnamed")]
    targets = [("big", 0.6, 1), ("small", 0.3, 3), ("empty", 0.1, 5), (None, 0.1, 1)]
    return spark.createDataFrame([(d, t, s, 9) for d, t, s in docs], "doc_id bigint, text string, source string, n_tokens int"), spark.createDataFrame(targets, "source string, target_share double, max_repeats int")


def test_mixture_shares_caps_and_order(spark):
    docs, targets = mixture_frames(spark)
    mix = mix_sources(docs, targets)
    rows = mix.collect()
    assert rows and [r["shuffle_key"] for r in rows] == sorted(r["shuffle_key"] for r in rows)
    assert len({(r["doc_id"], r["copy_no"]) for r in rows}) == len(rows)
    assert max(r["copy_no"] for r in rows if r["source"] == "small") <= 3 and max(r["copy_no"] for r in rows if r["source"] == "big") == 1
    shares = {r["source"]: r for r in mixture_shares(mix, targets).collect()}
    assert shares["empty"]["n_tokens"] == 0 and set(shares) == {"big", "small", "empty"}
    assert abs(shares["big"]["actual_share"] - 2 / 3) < 0.05
    assert {(r["doc_id"], r["copy_no"]) for r in mix_sources(docs.repartition(7), targets).collect()} == {(r["doc_id"], r["copy_no"]) for r in rows}
    assert mix_sources(docs.limit(0), targets).count() == 0 and mix_sources(docs, targets.limit(0)).count() == 0


def test_poisson_tables():
    for rate, cap in ((0.0, 3), (0.4, 1), (2.5, 4), (30.0, 60), (900.0, 1000)):
        table = poisson_table(rate, cap)
        assert len(table) <= cap and table == sorted(table) and table[-1] <= 1
        # the mean of the cut variable is the sum of what lies above each step
        assert abs(sum(1 - p for p in table) - expected_copies(rate, cap)) < 1e-6
    assert poisson_table(None, 5) == [] and abs(expected_copies(poisson_rate(700, 1000), 1000) - 700) < 1e-6


def test_many_repeats_and_deviation_by_size(spark):
    rng = random.Random(4)
    deviations = {}
    for size in (200, 20_000):
        docs = [(i, "alpha beta " * rng.randrange(1, 9), "big") for i in range(size)] + [(10**6 + i, "gamma delta " * rng.randrange(1, 9), "rare") for i in range(size // 40)]
        d = spark.createDataFrame(docs, "doc_id bigint, text string, source string")
        t = spark.createDataFrame([("big", 0.5, 1), ("rare", 0.5, 1000)], "source string, target_share double, max_repeats int")
        shares = {r["source"]: r for r in mixture_shares(mix_sources(d, t), t).collect()}
        assert 25 < shares["rare"]["most_copies"] <= 1000
        deviations[size] = abs(shares["rare"]["actual_share"] - 0.5)
    # the noise of the draw falls with the root of the number of documents
    assert deviations[20_000] < 0.01 and deviations[200] < 0.1


RESIDUE = [
    ("Reviewed by {{ reviewer }}.", "slot"), ("Value: <FORMULA>", "slot"), ("Cluster [INSERT Cluster Id] was reviewed.", "slot"), ("made for XXX pool name XXX", "slot"), ("Name: ____ (to be filled in)", "slot"), ("see %(batch date)s now", "slot"),
    ("[Write the summary in two sentences.]", "slot"), ("<!-- Title goes here -->", "slot"), ("TODO: describe it", "slot"), ("The sum is\n<insert figure\ncaption> here", "slot"),
    ("404 Not Found", "error"), ("<html><body><h1>502 Bad Gateway</h1></body></html>", "error"), ("PÁGINA NO ENCONTRADA. VUELVA AL INICIO.", "error"), ("The sample grew well.\nAccess denied.\nIt is cubic.", "error"),
    ("Please enable JavaScript to view this report.", "script"),
    # a second set, from pages of other kinds than the project's
    ("This site can't be reached. The server took too long to respond.", "error"), ("Sorry, the product you are looking for is no longer available.", "error"), ("Fatal error: database connection refused.", "error"), ("Please complete the captcha to continue.", "error"), ("We are currently down for maintenance. We'll be back soon!", "error"), ("Erro interno do servidor. Tente novamente.", "error"), ("Pagina non trovata", "error"),
    ("You need to enable JavaScript to run this app.", "script"), ("This website requires JavaScript to work properly.", "script"), ("Your browser does not support JavaScript!", "script"), ("Für diese Seite muss JavaScript aktiviert sein: bitte JavaScript aktivieren.", "script"),
    ("[Your company name]", "slot"), ("Dear {{ first_name }},", "slot"), ("Total: {{ order.total | currency, 2 }}", "slot"), ("[Insert, in two or three sentences, what was found, how sure you are of it, and whom the reader may ask if the figures of the table below don't agree]", "slot"), ("Report for %CUSTOMER%", "slot"), ("<% render page,\n header %>", "slot"), ("Text eingeben", "instruction"), ("Replace this text with your own.", "instruction"), ("Dies ist ein Blindtext.", "filler"), ("Veuillez activer\nJavaScript pour afficher le rapport.", "script"), ("Texto de relleno. Texto de relleno.", "filler"), ("Lorem ipsum dolor sit amet consectetur.", "filler"), ("Click here to enter text.", "instruction"),
]
CLEAN = [
    "Page not found errors in the crawl log concern 12 stale links and no data.", "A server error interrupted batch 9; the rows written before it are complete.", "Scripts are required only for plotting; the text above was checked by hand.",
    "Reflections {hkl} with h + k odd are absent, as are the {110} faces.", "Along [100] the stacking repeats, and <110> directions are equivalent.", r"the ratio is \frac{c}{a} = 1.6, see $E_{hull}$ in the table", 'settings {"pool": "wildcard", "quota": 10} in both runs',
    "Connection timed out twice during the nightly run, after which the fetch succeeded.", "We asked users to enable JavaScript in the 2019 survey of viewers.", "Die Seite wurde nicht gefunden, nachdem der Export verschoben war.", "The service was unavailable between 3 and 4 o'clock; batch 7 was repeated.", "JavaScript is required only by the old plotting code.",
    "Use of dummy text in the layout test ended with batch 3.", "We filled all TODO items from the last review and removed the sample rows.", "The template slot for the formula was open in the first draft; it now reads LiO2.", "Access to the older mirror was denied until the certificate was renewed.", "", "El vecino con dolor es JVASP-1.", "<b>bold</b> and <i>italic</i>",
]


@pytest.mark.parametrize("text,kind", RESIDUE)
def test_residue(text, kind):
    assert kind in residue_of(text)[0]


@pytest.mark.parametrize("text", CLEAN)
def test_clean(text):
    assert residue_of(text) == ([], 0.0)


def test_residue_table(spark):
    texts = [t for t, _ in RESIDUE] + CLEAN + [None, "word " * 200_000 + "\n404 Not Found"]
    rows = [(i, t, "k", 0.5) for i, t in enumerate(texts)] + [(0, texts[0], "k", 0.5), (None, "404 Not Found", "k", 0.5)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, kinds string, coverage double")
    found = find_residue(df).collect()
    assert {r["doc_id"] for r in found} == {*range(len(RESIDUE)), len(texts) - 1} and all(0 < r["coverage"] <= 1 for r in found)
    assert without_residue(df).count() == len(CLEAN) + 2
    assert find_residue(df.limit(0)).count() == 0
