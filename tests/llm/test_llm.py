"""Corpus operators against brute force, public tokenizers and held-out labels, with the odd cases."""

import base64
import random
import unicodedata
from collections import Counter

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from stratafold.llm import bpe, copies, languages, leakage, queries, term_counts
from tests import parity


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_agrees_with_sql(spark, name):
    parity.check(spark, queries.QUERIES[name], queries.ORACLES[name])


#: Rows and checksum, confidence aside, of queries without SQL.
KNOWN = {"p7_overlaps": (40, 608356001), "p8_found": (54, 248853147), "p8_segments": (426, 2065266590), "p8_spans": (341, 1003156616)}


def test_every_query_has_sql_or_a_known_answer():
    assert queries.QUERIES.keys() - queries.ORACLES.keys() == KNOWN.keys() | {"p6_ids", "p7_found"}


@pytest.mark.parametrize("name", sorted(KNOWN))
def test_query_gives_its_known_answer(spark, name):
    assert parity.digest(queries.QUERIES[name](spark, parity.DATA).drop("confidence")) == KNOWN[name]


def test_ids_of_the_documents_equal_the_public_tokenizer(spark):
    tokenizers = pytest.importorskip("tokenizers")
    public = tokenizers.Tokenizer.from_file(f"{bpe.TOKENIZERS}/byte_bpe_50k.json")
    public.encode_special_tokens = True
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{parity.DATA}/documents.parquet").collect()}
    assert {r.doc_id: r.ids for r in queries.p6_ids(spark, parity.DATA).collect()} == {i: public.encode(t or "", add_special_tokens=False).ids for i, t in texts.items()}


def test_leaks_of_the_documents_against_brute_force(spark):
    read = lambda table, *columns: [tuple(r) for r in spark.read.parquet(f"{parity.DATA}/{table}.parquet").select(*columns).collect()]
    expected = brute_leaks(read("documents", "doc_id", "text"), read("eval_items", "item_id", "text"))
    found = [tuple(r) for r in queries.p7_found(spark, parity.DATA).collect()]
    assert len(found) == len(set(found)) and set(found) == expected and expected


# --- copies


def brute_form(text):
    if text is None:
        return None
    parts = ["".join(c for c in unicodedata.normalize("NFC", p).upper().lower() if unicodedata.category(c)[0] in "LN") for p in regex.split("[,;|]", text)]
    return ",".join(sorted(p for p in parts if p)) or None


def brute_copies(rows):
    groups = {}
    for i, t in rows:
        if i is not None and brute_form(t):
            groups.setdefault(brute_form(t), []).append(i)
    return sorted((min(g), x) for g in groups.values() for x in sorted(g)[1:])


def test_copies_against_brute_force(spark):
    rnd = random.Random(5)
    words = ["Oak", "Rue", "é", "e", "é", "12", "st", "Straße", "STRASSE"]
    rows = []
    for i in rnd.sample(range(10**6), 2000):
        # A third of all rows are one record in many spellings.
        fields = ["Rue 12", "Oak"] if rnd.random() < 0.33 else [" ".join(rnd.choices(words, k=rnd.randint(1, 2))) for _ in range(rnd.randint(1, 3))]
        rnd.shuffle(fields)
        text = rnd.choice([", ", ";", "|", ",,"]).join(fields)
        rows.append((i, rnd.choice([text, text.upper(), text.replace(" ", " - "), f"({text})."])))
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "cache_id long, query string, form string, id int").repartition(3)
    assert sorted(tuple(r) for r in copies.surplus_copies(df, "cache_id", "query").collect()) == brute_copies(rows)
    counts = {r.keep_id: r.copies for r in copies.collapse(df, "cache_id", "query").collect()}
    assert sum(counts.values()) == len(rows) and len(counts) == len({brute_form(t) for _, t in rows})


def test_copies_when_one_record_fills_all_partitions(spark):
    df = spark.range(5000).select(F.col("id").alias("k"), F.when(F.col("id") % 2 == 0, "A b").otherwise("a  B;").alias("t"))
    found = copies.surplus_copies(df, "k", "t")
    assert found.count() == 4999 and found.select("keep_id").distinct().collect() == [(0,)]


def test_surplus_and_counts_agree_on_repeated_ids(spark):
    df = spark.createDataFrame([(1, "a"), (1, "A"), (2, "a"), (3, "b"), (3, "b")], "k long, t string")
    assert sorted(tuple(r) for r in copies.surplus_copies(df, "k", "t").collect()) == [(1, 1), (1, 2), (3, 3)]
    assert {r.keep_id: r.copies for r in copies.collapse(df, "k", "t").collect()} == {1: 3, 3: 2}


def test_copies_odd_cases(spark):
    rows = [(1, None), (2, ""), (3, " ;,| - "), (4, "a"), (4, "A"), (None, "a"), (5, "é"), (6, "é"), (7, "e"), (8, "x" * 200_000), (9, "X" * 200_000), (10, "a b"), (11, "b a"), (12, "b,a"), (13, "A|B"), (14, "a,a,b"), (15, "q\u0301a"), (16, "qa"), (17, "\u0301"), (18, "हिं"), (19, "ह")]
    df = spark.createDataFrame(rows, "k long, t string")
    assert sorted(tuple(r) for r in copies.surplus_copies(df, "k", "t").collect()) == [(4, 4), (5, 6), (8, 9), (12, 13), (15, 16), (18, 19)]
    assert {r.keep_id: r.copies for r in copies.collapse(df, "k", "t").collect()}[4] == 2
    assert copies.surplus_copies(df.limit(0), "k", "t").count() == 0


# --- term counts


def brute_terms(maps):
    occurrences, records = Counter(), Counter()
    for m in maps:
        terms = [(k, x.strip(" ")) for k, v in (m or {}).items() if v is not None for x in v.split(";") if x.strip(" ")]
        occurrences.update(terms)
        records.update(set(terms))
    return {t: (occurrences[t], records[t]) for t in occurrences}


def test_terms_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(term_counts, "BLOCK_TERMS", 50)
    monkeypatch.setattr(term_counts, "RANGE_SIZE", 16)
    rnd = random.Random(2)
    maps = [None, {}, {"k": None}, {"k": " ; ;"}, {"k": "a;a; a ;A\t"}, {"": "x"}] + [{"hot": "yes;" * rnd.randint(1, 3), rnd.choice("abc"): ";".join(rnd.choices([str(i) for i in range(90)], k=4))} for _ in range(600)]
    df = spark.createDataFrame([(m, 1, "z") for m in maps], "tags map<string,string>, key int, item string").repartition(4)
    got = term_counts.count_terms(df, "tags").collect()
    assert {(r["key"], r["item"]): (r.occurrences, r.records) for r in got} == brute_terms(maps)
    assert sorted(r.term_id for r in got) == list(range(len(got)))
    assert [(r["key"], r["item"]) for r in sorted(got, key=lambda r: r.term_id)] == sorted((r["key"], r["item"]) for r in got)


def test_marks(spark):
    maps = [{"k": "c"}] * 11 + [{"k": "b"}] * 10 + [{"k": "r;r;r"}] * 2 + [None] * 77
    df = spark.createDataFrame([(m,) for m in maps], "tags map<string,string>")
    assert sorted(tuple(r) for r in term_counts.mark_terms(df, "tags").collect()) == [("k", "c", "common"), ("k", "r", "rare")]
    tiny = spark.createDataFrame([({"k": "v"},)], "tags map<string,string>")
    assert sorted(r.mark for r in term_counts.mark_terms(tiny, "tags").collect()) == ["common", "rare"]
    assert term_counts.mark_terms(df.limit(0), "tags").count() == 0


# --- byte-level BPE


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.load_vocabulary()


def odd_texts():
    rnd = random.Random(9)
    noise = base64.b64encode(bytes(rnd.randrange(256) for _ in range(3000))).decode()
    return [None, "", " ", "\n\n  \t x", "a" * 3000, "ab" * 1500 + "é" * 300, "<|endoftext|> hi", "don't we'll 'S", "　x\xa0 y", "🙂👩‍👩‍👧", noise, "=-" * 900, "é", "naïve Straße 12345 x²"]


def test_ids_equal_the_public_tokenizer(spark, vocabulary):
    tokenizers = pytest.importorskip("tokenizers")
    public = tokenizers.Tokenizer.from_file(f"{bpe.TOKENIZERS}/byte_bpe_50k.json")
    public.encode_special_tokens = True
    texts = odd_texts() + [r.text for r in spark.read.parquet(f"{parity.DATA}/documents.parquet").collect()]
    df = spark.createDataFrame([(i, t, [1]) for i, t in enumerate(texts)] * 2, "doc_id long, text string, ids array<int>")
    encoded = bpe.encode(df, "doc_id", "text", vocabulary)
    expected = [e.ids for e in public.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    got = encoded.collect()
    assert len(got) == 2 * len(texts)
    assert all(r.ids == expected[r.doc_id] for r in got)
    assert all(r.text == (texts[r.doc_id] or "") for r in bpe.decode(encoded, "doc_id", "ids", vocabulary).collect())
    assert bpe.encode(df.limit(0), "doc_id", "text", vocabulary).count() == 0


def test_words_longer_than_one_recursion(vocabulary, monkeypatch):
    tiktoken = pytest.importorskip("tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(f"{bpe.TOKENIZERS}/byte_bpe_50k.tiktoken", "rb"))}
    public = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rnd = random.Random(4)
    texts = ["".join(rnd.choices("etaoinshrdlu", k=2000)) for _ in range(3)] + ["a" * 4999, "ab" * 3000 + "=" * 700, "".join(rnd.choices("éßabc世界", k=900)), "x" * 65]
    encoder = bpe.Encoder(vocabulary)
    expected = [public.encode_ordinary(t) for t in texts]
    assert [list(x) for x in encoder.encode(texts)] == expected
    # Small pieces, cut anew in each pass, and few rounds a query.
    monkeypatch.setattr(bpe, "PIECE", 120)
    monkeypatch.setattr(bpe, "HELD_ROWS", 500)
    assert [list(x) for x in encoder.encode(texts)] == expected
    assert not any(len(w) > bpe.SHORT for w in encoder.known)


def test_plain_texts_are_cut_alike(vocabulary):
    cut = regex.compile(bpe.PATTERN).findall
    signs = [chr(i) for i in range(0x3000) if bpe._PLAIN_TEXT.fullmatch(chr(i))]
    assert len(signs) > 800
    for c in signs:
        text = f"a {c}b 1{c}2  {c} {c}{c} 's'{c}\n {c}"
        assert bpe._PLAIN_WORDS.findall(text) == cut(text), hex(ord(c))
    rnd = random.Random(3)
    for _ in range(3000):
        text = "".join(rnd.choices(signs + list(" \n\t'sdtrevml") * 20, k=rnd.randint(0, 30)))
        assert bpe._PLAIN_WORDS.findall(text) == cut(text), text


def test_a_word_of_a_million_letters(vocabulary):
    tiktoken = pytest.importorskip("tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(f"{bpe.TOKENIZERS}/byte_bpe_50k.tiktoken", "rb"))}
    public = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    word = "".join(random.Random(6).choices("etaoinshrdlu", k=1_000_000))
    assert bpe.Encoder(vocabulary).encode([word])[0].tolist() == public.encode_ordinary(word)


# --- leakage


def brute_leaks(documents, items, span=12):
    out = set()
    for i, t in documents:
        d = leakage.words_of(t)
        runs = {tuple(d[k : k + span]) for k in range(len(d) - span + 1)}
        for j, u in items:
            w = leakage.words_of(u)
            if any(tuple(w[k : k + span]) in runs for k in range(len(w) - span + 1)):
                out.add((i, j))
    return out


@pytest.mark.parametrize("block", [leakage.BLOCK_CHARS, 2500])
def test_leaks_against_brute_force(spark, monkeypatch, block):
    # The smaller block has the items joined by their seeds; the small parts cut hits and texts up.
    monkeypatch.setattr(leakage, "BLOCK_CHARS", block)
    monkeypatch.setattr(leakage, "HITS", 50)
    monkeypatch.setattr(leakage, "TEXTS", 40)
    rnd = random.Random(8)
    words = [f"w{i}é" for i in range(60)]
    items = [(j, " ".join(rnd.choices(words, k=rnd.choice([5, 11, 12, 13, 40])))) for j in range(40)]
    documents = []
    for i in range(300):
        text = rnd.choices(words, k=rnd.randint(0, 80))
        if i % 3:
            item = items[rnd.randrange(40)][1].split()
            lo = rnd.randint(0, max(0, len(item) - 12))
            text[len(text) // 2 : len(text) // 2] = item[lo : lo + rnd.choice([11, 12, 13, 30])]
        documents.append((i, rnd.choice([" ", " -- ", ", "]).join(rnd.choice([w, w.upper()]) for w in text)))
    documents += [(900, None), (901, ""), (902, "!!"), (903, " ".join(items[-1][1].split() * 3000))]
    df = spark.createDataFrame([(*d, "x", 2) for d in documents + documents[:20]], "doc_id long, text string, item string, exact_words int").repartition(3)
    tests = spark.createDataFrame([*items, items[0], (None, "x"), (77, None)], "item_id long, text string")
    found = leakage.leaks(df, "doc_id", "text", tests, "item_id", "text").collect()
    exact = [(r.doc_id, r.item_id) for r in found if r.exact_words >= 12]
    assert len(exact) == len(set(exact)) and set(exact) == brute_leaks(documents, items)
    assert leakage.leaks(df.limit(0), "doc_id", "text", tests, "item_id", "text").count() == 0
    assert leakage.leaks(df, "doc_id", "text", tests.limit(0), "item_id", "text").count() == 0


def test_substitutions_are_tolerated(spark):
    item = [f"t{i}" for i in range(30)]
    near = list(item)
    near[6], near[14], near[23] = "x", "y", "z"
    df = spark.createDataFrame([(1, "a b " + " ".join(near) + " c"), (2, " ".join(w if i % 2 else "q" for i, w in enumerate(item)))], "d long, t string")
    rows = leakage.leaks(df, "d", "t", spark.createDataFrame([(5, " ".join(item))], "i long, t string"), "i", "t").collect()
    assert [(r.doc_id, r.item_id, r.exact_words, r.doc_pos, r.item_pos, r.overlap_words, r.substitutions) for r in rows] == [(1, 5, 8, 2, 0, 30, 3)]


def test_both_ways_give_the_same_overlaps(spark, monkeypatch):
    read = lambda table: spark.read.parquet(f"{parity.DATA}/{table}.parquet")
    found = [sorted(tuple(r) for r in queries.p7_overlaps(spark, parity.DATA).collect())]
    monkeypatch.setattr(leakage, "BLOCK_CHARS", 1000)
    found.append(sorted(tuple(r) for r in leakage.leaks(read("documents"), "doc_id", "text", read("eval_items"), "item_id", "text").collect()))
    assert found[0] and found[0] == found[1]


def test_recall_of_substituted_overlaps():
    # Passages of 30 words of an item, of which one to five are others, within other words.
    rnd = random.Random(12)
    items = [(j, " ".join(f"w{rnd.randrange(2000)}" for _ in range(60))) for j in range(50)]
    index = leakage.SeedIndex(items)
    import pyarrow as pa

    for substituted in range(1, 6):
        texts, truth = [], []
        for i in range(200):
            j, at = rnd.randrange(50), rnd.randrange(31)
            passage = items[j][1].split()[at : at + 30]
            for k in rnd.sample(range(30), substituted):
                passage[k] = f"x{rnd.randrange(2000)}"
            around = [f"y{rnd.randrange(2000)}" for _ in range(40)]
            texts.append(" ".join(around[:20] + passage + around[20:]))
            truth.append((i, j))
        batch = pa.RecordBatch.from_arrays([pa.array(range(200), pa.int64()), pa.array(texts)], names=["k", "t"])
        found = {(d, i) for out in leakage._join(iter([batch]), index) for d, i in zip(out.column(0).to_pylist(), out.column(1).to_pylist())}
        recall = len(found & set(truth)) / len(truth)
        assert recall >= (0.99 if substituted <= 4 else 0.9), (substituted, recall)
        assert found <= set(truth)


def test_plain_texts_have_the_same_words():
    signs = [chr(i) for i in range(0x3000) if leakage._PLAIN_TEXT.fullmatch(chr(i))]
    assert len(signs) > 800
    for c in signs:
        assert leakage._PLAIN_WORD.findall(f"a{c}b _{c} 1{c}") == regex.findall(leakage._WORD, f"a{c}b _{c} 1{c}"), hex(ord(c))


def test_every_mask_catches_an_exact_run():
    ids = np.arange(12, dtype=np.int64)
    assert all(len(m) == leakage.SPAN and m[0] == m[-1] == "1" and len(leakage.seed_hashes(ids, m)[0]) == 1 for m in leakage.MASKS)


# --- languages


@pytest.fixture(scope="module")
def samples(spark):
    return [(r.lang, r.text) for r in spark.read.parquet(f"{parity.DATA}/lang_samples.parquet").orderBy("sample_id").collect()]


def test_held_out_accuracy(samples):
    model = languages.fit(samples[:200])
    found = languages.Labeller(model).label([t for _, t in samples[200:]]).letters
    right = [model.languages[int(f.argmax())] == lang for f, (lang, _) in zip(found, samples[200:])]
    assert np.mean(right) >= 0.97


def test_confidence_is_calibrated_on_held_out_texts(samples):
    # Pieces of two to sixteen words, which are often wrong; neither the model nor its curve has seen their texts.
    model = languages.calibrate(languages.fit(samples[:200]), samples[:200])
    pieces = [(lang, " ".join(t.split()[:n])) for lang, t in samples[200:] for n in (1, 2, 4, 8, 16)]
    done = languages.Labeller(model).label([t for _, t in pieces])
    sure = model.confidence(done.margin, done.letters.sum(axis=1))
    right = np.array([model.languages[int(f.argmax())] == lang for f, (lang, _) in zip(done.letters, pieces)])
    edges = np.digitize(sure, [0.5, 0.8, 0.95])
    gap = sum(abs(sure[edges == e].mean() - right[edges == e].mean()) * (edges == e).mean() for e in np.unique(edges))
    assert gap < 0.06 and sure[right].mean() > sure[~right].mean() + 0.2


def test_plain_lines_have_the_same_words():
    signs = [chr(i) for i in range(0x3000) if languages._PLAIN_LINE.fullmatch(chr(i))]
    assert len(signs) > 700
    for c in signs:
        assert languages._PLAIN_WORD.findall(f"a{c}b é") == languages._WORD.findall(f"a{c}b é"), hex(ord(c))


def test_scripts_of_letters():
    letters = {"a": "Latin", "é": "Latin", "ж": "Cyrillic", "λ": "Greek", "ע": "Hebrew", "ع": "Arabic", "ह": "Devanagari", "水": "Han", "ひ": "Hiragana", "カ": "Katakana", "한": "Hangul", "ก": "Thai", "ა": "Georgian", "𐌀": "Old_Italic", "Ａ": "Latin", "µ": "Greek", "አ": "Ethiopic"}
    assert {c: languages.script_of_letter(c) for c in letters} == letters
    assert languages.words_of("हिंदी घर, 水曜日 ไทย don't éa") == ["हिंदी", "घर", "水", "曜", "日", "ไ", "ท", "ย", "don", "t", "éa"]
    assert languages.script_of("naïve") == "Latin" and languages.script_of("жa") == "Cyrillic"


def test_letters_of_foreign_scripts_do_not_count(samples):
    labeller = languages.Labeller(languages.fit(samples))
    done = labeller.label(["Ελληνικά κείμενα χωρίς γλώσσα του μοντέλου", "水曜日 " * 20, "Все дороги ведут к горам"])
    assert done.letters.sum(axis=1).tolist() == [0, 0, 20] and labeller.model.languages[int(done.letters[2].argmax())] == "ru"


def test_spans_of_mixed_text(spark, samples):
    model = languages.calibrate(languages.fit(samples), samples)
    long = {lang: max((t.replace("\n", " ") for k, t in samples if k == lang), key=len) for lang in ("en", "de")}
    count = {lang: len(languages.words_of(t)) for lang, t in long.items()}
    rows = [(1, f"{long['en']} {long['de']}\n\n{long['de']}"), (2, None), (3, ""), (4, "ελ"), (5, long["de"])]
    found = languages.spans(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, span int"), "doc_id", "text", model).collect()
    got = sorted((r.doc_id, r.segment, r.span, r.lang, r.first_word, r.words) for r in found)
    assert [(*g[:4],) for g in got] == [(1, 0, 0, "en"), (1, 0, 1, "de"), (1, 1, 0, "de"), (5, 0, 0, "de")]
    # The cut lies within a few words of the seam, and every word is in one span.
    assert abs(got[0][5] - count["en"]) <= 3 and got[1][4] == got[0][5] and got[2][4] == count["en"] + count["de"]
    assert got[0][5] + got[1][5] == count["en"] + count["de"] and got[3][5] == count["de"]
    assert all(0.5 < r.confidence <= 1 for r in found)


def test_viterbi_against_brute_force():
    rng = np.random.default_rng(7)
    sizes = np.array([3, 0, 1, 5, 4])
    score = rng.normal(0, 5, (sizes.sum(), 3))
    got = languages.viterbi(score, sizes)
    at = 0
    for n in sizes:
        part = score[at : at + n]
        if n:
            paths = np.stack(np.meshgrid(*[range(3)] * n, indexing="ij"), -1).reshape(-1, n)
            value = part[np.arange(n), paths].sum(1) - languages.SWITCH_PENALTY * (np.diff(paths, axis=1) != 0).sum(1)
            mine = part[np.arange(n), got[at : at + n]].sum() - languages.SWITCH_PENALTY * (np.diff(got[at : at + n]) != 0).sum()
            assert mine == pytest.approx(value.max())
        at += n


def test_segments_of_odd_documents(spark, samples):
    # How log lines and markup look is learned from labelled documents.
    read = lambda table: spark.read.parquet(f"/root/testdata/sf0.01/{table}.parquet")
    model = languages.train(read("lang_samples"), read("documents"), "doc_id", "text", "lang")
    text = {lang: next(t for k, t in samples if k == lang and len(t) > 80) for lang in ("en", "de", "fr", "ru")}
    rows = [
        (1, None, "en"), (2, "", None), (3, " \n\t\n", "de"), (4, "12 !! 34", "de"), (5, "kurz", "en"),
        (6, text["de"], "de-AT"), (7, text["de"], " DE "), (8, text["de"], "en"), (9, text["ru"], "und"), (10, text["fr"].upper(), ""),
        (11, f"{text['en']}\r\n\r\nab\r\n \r\n{text['de']}\n\n\n{text['en']}", "en"),
        (12, f'{text["de"]} "{text["en"].split(".")[0][:40]}" {text["de"]}', "de"),
        (13, '{"rows": 53, "columns": 54, "base_mm": 2.3, "place_name": "Drosivlord"}\n<trkpt lat="46.16"><ele>1614.5</ele></trkpt> <!-- Bebalin -->', "de"),
        (None, text["fr"], "de"), (14, text["en"] * 300, "fr"),
    ]
    df = spark.createDataFrame([(*r, 1, "q") for r in rows + rows[:1]], "doc_id long, text string, lang string, segment int, label string")
    found = languages.segments(df, "doc_id", "text", "lang", model)
    assert sorted((r.doc_id or 0, r.segment, r.lang) for r in languages.relabelled(found).collect()) == sorted([(8, -1, "de"), (9, -1, "ru"), (10, -1, "fr"), (11, 0, "en"), (11, 2, "de"), (11, 3, "en"), (13, -1, "en"), (0, -1, "fr"), (14, -1, "en")])
    assert all(0 <= r.confidence <= 1 for r in found.collect())
    assert found.limit(0).count() == 0


def test_no_samples_is_an_error():
    with pytest.raises(ValueError, match="no samples"):
        languages.fit([])


def test_workers_need_no_copy_of_the_package(tmp_path):
    import os
    import subprocess
    import sys
    from pathlib import Path

    code = (
        f"import sys; sys.path.insert(0, {str(Path(__file__).parents[2])!r})\n"
        "from pyspark.sql import SparkSession\n"
        "s = SparkSession.builder.master('local[2]').config('spark.sql.shuffle.partitions', '2').config('spark.ui.enabled', 'false').config('spark.sql.session.timeZone', 'UTC').getOrCreate()\n"
        "from stratafold.llm import queries\n"
        "for q in queries.QUERIES:\n"
        "    assert queries.QUERIES[q](s, '/root/testdata/sf0.001').count() > 0, q\n"
    )
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
