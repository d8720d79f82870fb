"""Leakage, languages and packing against brute force and on awkward texts."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.llm.language import Model, detect_languages, fit, label_code, segments
from riskloom.llm.leakage import Automaton, leak_spans, leaked_items, remove_leaks
from riskloom.llm.packing import Limits, encoder, fullness, pack, place, token_sizes
from riskloom.llm.textnorm import plain, word_places, words

ITEM = "Not until 115 spare tiles doubted the borrowed compass did Ruoth count the northern beacon beyond Ruhesk"


@pytest.mark.parametrize(
    "text",
    [
        ITEM.upper(), ITEM.replace(" ", "  \t"), ITEM.replace(" ", "\n> "), "<p>" + ITEM.replace("tiles", "<b>tiles</b>").replace("the", "<i>the</i>") + "</p>", ITEM.replace(" ", "&nbsp;"),
        ITEM.replace("compass", "com-\npass"), ITEM.replace("beacon", "bea­con").replace("spare", "sp​are"), ITEM.replace("o", "ó"), ITEM.replace("borrowed", "**borrowed**,"),
        "".join(chr(ord(c) + 0xFEE0) if c.isascii() and c.isalnum() else c for c in ITEM), ITEM.replace("a", "\u0430").replace("o", "\u043e"),
    ],
)
def test_same_words(text):
    assert words(text) == words(ITEM)


def test_encodings():
    for t in ("El dueño acepta una contraseña más", "Тем временем всё", "prüfen Sie, ob’s läuft", "usunął połączenie"):
        broken = "".join(chr(b) if 0x80 <= b < 0xA0 and bytes([b]).decode("cp1252", "ignore") == "" else bytes([b]).decode("cp1252", "ignore") or chr(b) for b in t.encode())
        assert plain(broken) == t and plain(t) == t
    assert plain("a &lt; b") == "a < b" and plain("") == "" and words("") == []


def covered(item, text, run):
    out = set()
    for i in range(len(item) - run + 1):
        for j in range(len(text) - run + 1):
            if item[i : i + run] == text[j : j + run]:
                out |= set(range(i, i + run))
    return out


def test_automaton_against_brute_force():
    rng = random.Random(9)
    items = [(n, [rng.choice("abc") for _ in range(rng.randrange(0, 14))]) for n in range(12)]
    items += [(20, items[3][1]), (21, items[3][1][:-1] + ["z"]), (22, ["q", *items[5][1]])]
    for run in (2, 3, 6):
        auto = Automaton(items, run)
        for _ in range(150):
            text = [rng.choice("abczq-") for _ in range(rng.randrange(0, 40))]
            if rng.random() < 0.5:
                text += rng.choice(items)[1] + ["!"] + rng.choice(items)[1][2:]
            got = {items[k][0]: v for k, v in auto.covered(text).items()}
            assert got == {n: c for n, ws in items if (c := covered(ws, text, run))}


def test_leaked_items(spark):
    other = ITEM.replace("northern", "southern")
    docs = [(1, f"before\n{ITEM.lower()}\nafter"), (2, " ".join(ITEM.split()[:5])), (3, " ".join(ITEM.split()[6:])), (4, None), (5, ""), (None, ITEM), (6, "x " * 60_000 + ITEM), (6, ITEM)]
    d = spark.createDataFrame(docs, "doc_id int, text string").withColumn("item_id", F.lit("clash"))
    items = spark.createDataFrame([(1, ITEM), (2, other), (3, None), (None, ITEM), (4, "too short")], "item_id int, item_text string")
    want = [(1, 1), (1, 2), (3, 1), (6, 1), (6, 1), (6, 2), (6, 2)]
    for block in (200_000, 3):
        got = leaked_items(d, "doc_id", "text", items, "item_id", "item_text", block_words=block).collect()
        assert sorted((r.doc_id, r.item_id) for r in got) == want
    assert leaked_items(d, "doc_id", "text", items.limit(0), "item_id", "item_text").count() == 0
    assert leaked_items(d.limit(0), "doc_id", "text", items, "item_id", "item_text").count() == 0


@pytest.mark.parametrize("block", [200_000, 3])
def test_remove_leaks(spark, block):
    marked = ITEM.replace("tiles", "<b>ti</b>les").replace("compass", "com-\npass").replace(" the ", "&nbsp;the ")
    half = " ".join(ITEM.split()[:8])
    docs = [(1, f"before {marked} after"), (2, f"a {half} b"), (3, None), (4, ""), (5, "nothing here"), (None, ITEM), (6, f"{ITEM} und {ITEM.upper()}!"), (7, "é <i>x</i> " + ITEM)]
    d = spark.createDataFrame(docs, "doc_id int, text string").withColumn("start", F.lit("clash"))
    items = spark.createDataFrame([(1, ITEM), (2, "too short"), (None, ITEM)], "item_id int, item_text string")
    args = (d, "doc_id", "text", items, "item_id", "item_text")
    got = {r.doc_id: (r.text, r.removed) for r in remove_leaks(*args, block_words=block).collect()}
    want = {1: "before  after", 2: docs[1][1], 3: None, 4: "", 5: "nothing here", 6: " und !", 7: "é <i>x</i> "}
    assert got == {i: (want[i], len(t or "") - len(want[i] or "")) for i, t in docs if i}
    spans = leak_spans(*args, block_words=block).collect()
    assert {(r.doc_id, r.item_id, r.n_words) for r in spans} == {(1, 1, 17), (6, 1, 17), (7, 1, 17)}
    assert all(words(docs[[x[0] for x in docs].index(r.doc_id)][1][r.start : r.stop]) == words(ITEM) for r in spans)
    short = remove_leaks(*args, longest=8, block_words=block).where("doc_id = 2").first()
    assert short.text == "a  b"


def test_places_of_words():
    rng = random.Random(3)
    bits = [*"aZ9 \n-<>&;", "<b>", "</b>", "<td a='1'>", "&amp;", "&eacute;", "&#1078;", "\u00ad", "ü", "Ã¼", "É", "ß", "ﬁ", "İ", "Σ", "日本", "-\n", "<!-- x\ny -->", "wort", "а", "e\u0301", "Â ", "ℌ"]
    for _ in range(3_000):
        t = "".join(rng.choice(bits) for _ in range(rng.randrange(0, 25)))
        ws, at = words(t), word_places(t)
        assert len(ws) == len(at) and all(0 <= a < b <= len(t) for a, b in at), t
        assert [words(t[a:b])[:1] for a, b in at] == [[w] for w in ws] or any(c in t for c in "<&Ã\u00adÂ-Σа"), t


def test_shared_instruction_is_cheap():
    """Many items that share a closing: a text with the closing alone marks none of them."""
    closing = "answer with the letter of the one right option only please".split()
    items = [(n, [f"w{n}x{k}" for k in range(40)] + closing) for n in range(2_000)]
    auto = Automaton(items, 6)
    assert len(auto.end_item) == sum(len(ws) for _, ws in items)
    assert auto.covered(["x", *closing, "y"], 0.5) == {}
    leaked = {i for i, places in auto.covered(["x", *items[7][1][:30], *closing], 0.5).items() if len(places) >= 26}
    assert leaked == {7} and len(auto.covered(["x", *closing], 0.0)) == 2_000


def test_labels():
    assert [label_code(x) for x in ("en", "EN-gb", "English", "deu", "ger", "pl_PL", "pt-BR", "русский", "Français", "xx", "und", "", None, "unknown", "de_AT.UTF-8", "no language", "el texto", "English (US)", "no", "de-de(x)")] == [
        "en", "en", "en", "de", "de", "pl", "pt", "ru", "fr", None, None, None, None, None, "de", None, None, "en", "no", "de"]


def test_languages(spark, sf):
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet")
    model = fit(docs, "doc_id", "text", "lang", fit_docs=400)
    en, de, ru = "The owner accepted the risk of weak encryption.", "Der alte Dateiserver nutzt noch ein gemeinsames Kennwort.", "Владелец пока допускает устаревший протокол."
    rows = [(1, f"{en}\n10.1.1.1:5 -> 10.2.2.2 0x1f\n\n{en}\n{de}\nT-123\n{ru}", "en"), (2, None, "en"), (3, "", None), (4, "T-1\n[1] 2.3/4 :: 5;6 0x7", None), (5, de.upper(), "German"), (6, (en + "\n") * 4_000, None), (None, en, "en")]
    d = spark.createDataFrame(rows, "doc_id int, text string, lang string").withColumn("seg_no", F.lit("clash")).withColumn("confidence", F.lit(None).cast("string"))
    got = {}
    for r in detect_languages(d, "doc_id", "text", "lang", model).collect():
        got.setdefault(r.doc_id, {})[r.seg_no] = (r.lang, r.first_line, r.last_line, r.langs, r.label)
        assert (0.5 if r.seg_no else 0.3) < r.confidence <= 1
    assert got == {1: {0: ("en", 0, 6, 3, "en"), 1: ("en", 0, 3, 3, "en"), 2: ("de", 4, 4, 3, "en"), 3: ("ru", 6, 6, 3, "en")}, 5: {0: ("de", 0, 0, 1, "de"), 1: ("de", 0, 0, 1, "de")},
                   6: {0: ("en", 0, 3999, 1, None), 1: ("en", 0, 3999, 1, None)}}
    assert detect_languages(d.limit(0), "doc_id", "text", "lang", model).count() == 0
    assert fit(d.limit(0), "doc_id", "text", "lang").langs


def test_held_out_accuracy(spark, sf):
    """Labels are right for most documents of one language; the model, fitted on a part, must agree on the rest."""
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet").where("length(text) > 60")
    seen, rest = docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1")
    rows = detect_languages(rest, "doc_id", "text", "lang", fit(seen, "doc_id", "text", "lang", fit_docs=250)).where("seg_no = 0 AND langs = 1 AND label IS NOT NULL").collect()
    for lang in ("de", "fr", "es", "pl", "nl", "it"):
        mine = [r for r in rows if r.label == lang]
        own = Counter(r.lang for r in mine)
        assert own.most_common(1)[0][0] == lang, (lang, own)
    assert np.mean([r.lang == r.label for r in rows]) > 0.88  # about a tenth of the labels is wrong


def test_confidence_is_calibrated(spark, sf):
    """Of short held-out lines, those of a confidence near c are right about c of the time."""
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet")
    model = fit(docs.where("doc_id % 2 = 0"), "doc_id", "text", "lang")
    whole = detect_languages(docs.where("doc_id % 2 = 1"), "doc_id", "text", "lang", model).where("seg_no = 0 AND langs = 1 AND lang = label AND chars > 200").select("doc_id", "label")
    some = docs.join(whole, "doc_id").select(F.col("doc_id"), F.explode(F.split("text", "\n")).alias("line"), "label")
    parts = some.select(F.monotonically_increasing_id().alias("i"), "label", F.array_join(F.slice(F.split("line", " "), 1, 2), " ").alias("text")).where("text <> ''").cache()
    rows = detect_languages(parts.withColumnRenamed("label", "lang"), "i", "text", "lang", model).where("seg_no = 1").select("lang", "label", "confidence").collect()
    for lo, hi in ((0.3, 0.6), (0.6, 0.85), (0.85, 0.97), (0.97, 1.01)):
        mine = [r for r in rows if lo <= r.confidence < hi]
        if len(mine) >= 40:
            right, said = np.mean([r.lang == r.label for r in mine]), np.mean([r.confidence for r in mine])
            assert abs(right - said) < 0.2, (lo, len(mine), right, said)
    assert len(rows) > 300


def test_backoff_for_unseen_words():
    m = Model({("de", w): 5.0 for w in "verschlüsselung netzwerkdienst kennwort".split()} | {("it", w): 5.0 for w in "crittografia collegamento password".split()})
    assert next(segments(m, "verschlusselungen kennworter"))[1] == "de"
    assert next(segments(m, "collegamenti crittografici"))[1] == "it"
    assert list(segments(m, "12 34\n\n0xff")) == []


def check_packing(rows, limits):
    boxes = {}
    for r in rows:
        boxes.setdefault(r.container, []).append(r)
    for b in boxes.values():
        assert sum(r.n_tokens for r in b) <= limits.tokens and len(b) <= limits.segments and sum(r.n_loss for r in b) <= limits.loss
        assert sorted(r.place for r in b) == list(range(len(b)))
    return boxes


@pytest.mark.parametrize("limits", [Limits(100, 8, 100), Limits(100, 3, 100), Limits(100, 50, 90)])
def test_pack(spark, limits):
    rng = random.Random(1)
    items = [(i, rng.randrange(0, 60), rng.randrange(0, 15)) for i in range(900)] + [(5000, 1_234, 7), (5001, None, None), (None, 5, 0), (5002, 100, 100), (5003, 0, 0)]
    df = spark.createDataFrame([(*x, "clash") for x in items], "id int, n int, h int, piece string")
    rows = pack(df, "id", "n", "h", limits, group_items=300).collect()
    boxes = check_packing(rows, limits)
    pieces = {}
    for r in rows:
        pieces.setdefault(r.id, []).append((r.first_token, r.last_token))
    for i, n, _ in items:
        if i is None:
            continue
        cuts = sorted(pieces.pop(i))
        n = n or 0
        assert cuts[0][0] == 0 and cuts[-1][1] == n and all(a[1] == b[0] for a, b in zip(cuts, cuts[1:]))
        assert len(cuts) == max(1, -(-n // min(limits.tokens, limits.loss)))
    assert not pieces
    need = max(sum(r.n_tokens for r in rows) / limits.tokens, len(rows) / limits.segments, sum(r.n_loss for r in rows) / limits.loss)
    assert len(boxes) <= need * (1.12 if limits.segments == 3 else 1.06) + 4
    assert pack(df.limit(0), "id", "n", "h", limits).count() == 0


def test_place_is_tight():
    sizes = np.array([[60, 1, 60], [40, 1, 40], [50, 1, 50], [50, 1, 50], [99, 1, 99], [1, 1, 1]], float)
    assert len(set(place(sizes, np.array([100.0, 10, 100])))) == 3


def test_fullness(spark):
    rng = random.Random(2)
    limits = Limits(100, 5, 90)
    df = spark.createDataFrame([(i, rng.choice([3, 5, 8, 40, 60]), rng.randrange(0, 3)) for i in range(600)], "id int, n int, h int")
    packed = pack(df, "id", "n", "h", limits).cache()
    f = fullness(packed, limits).first()
    rows = packed.collect()
    assert f.containers == len({r.container for r in rows}) >= f.least
    assert f.least == max(-(-sum(r.n_tokens for r in rows) // 100), -(-len(rows) // 5), -(-sum(r.n_loss for r in rows) // 90))
    assert min(f.bound_by_tokens, f.bound_by_segments, f.bound_by_loss) > 0 and abs(f.tokens_used - sum(r.n_tokens for r in rows) / 100 / f.containers) < 1e-9
    assert fullness(packed.limit(0), limits).first().containers == 0


def test_token_sizes(spark):
    texts = [(1, "T-123\nSome text here"), (2, ""), (3, None), (4, "naïve 東京 " * 3_000), (5, "no head line at all")]
    df = spark.createDataFrame(texts, "doc_id int, text string").withColumn("n_tokens", F.lit(-1))
    got = {r.doc_id: (r.n_tokens, r.n_head) for r in token_sizes(df, "doc_id", "text").collect()}
    from riskloom.llm.packing import TOKENIZER

    enc = encoder(TOKENIZER)
    assert {i: n for i, (n, _) in got.items()} == {i: len(enc.encode_ordinary(t or "")) for i, t in texts}
    assert got[1][1] > 0 and got[5][1] == 0 and enc.decode(enc.encode_ordinary(texts[3][1])) == texts[3][1]
