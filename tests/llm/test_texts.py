"""Text operators: round trips, brute force and edge cases."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from nearfield.llm.encoding import CHAINS, Detector, corpus_statistics, garble, restore_encoding, train, word_bucket
from nearfield.llm.mix import mixture
from nearfield.llm.pack import pack_windows, packed_windows, window_report
from nearfield.llm.split import split_elements, split_text, token_sizes
from nearfield.llm.tokens import DEFAULT_TOKENIZER, POSITION_TOKENIZER, encoder, load
from nearfield.session import persist_table

DOCS = "doc_id long, text string, source string"


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab .\n\r。é́👨‍👩🙂x", max_size=300), st.integers(5, 60), st.integers(0, 4))
def test_split_loses_nothing(text, limit, overlap):
    pieces = split_text(text, limit, overlap)
    assert pieces[0].start == 0 and pieces[-1].end == len(text)
    assert "".join(text[p.start + p.overlap : p.end] for p in pieces) == text
    for a, b in zip(pieces, pieces[1:]):
        assert b.start == a.end - b.overlap and b.end > a.end and b.start > a.start
    assert all(p.end - p.start <= limit for p in pieces)
    assert len(pieces) == 1 or len(text) > limit


def test_split_prefers_natural_boundaries():
    text = "One two three. Four five six.\n\nSeven eight nine ten eleven twelve."
    assert [text[p.start : p.end] for p in split_text(text, 40, 0)] == ["One two three. Four five six.\n\n", "Seven eight nine ten eleven twelve."]
    assert [p.cut for p in split_text("word " * 30, 22, 0)][:2] == ["word", "word"]
    hard = split_text("x" * 100, 30, 5)
    assert [p.cut for p in hard] == ["hard"] * 3 + ["end"] and all(p.overlap == 5 for p in hard[1:])
    assert len(split_text("x" * 30, 30, 5)) == 1 and len(split_text("", 30, 5)) == 1
    with pytest.raises(ValueError):
        split_text("abc", 2, 2)


def test_split_by_tokens():
    tok = load(POSITION_TOKENIZER)
    text = "The quick brown fox jumps over the lazy dog. " * 20
    pieces = split_text(text, 50, 8, token_sizes(tok))
    assert len(pieces) > 3 and all(p.size <= 50 for p in pieces)
    assert "".join(text[p.start + p.overlap : p.end] for p in pieces) == text


def test_split_elements(spark):
    long = "Some sentence here. " * 200
    rows = [(1, [None, "short", long, ""]), (1, [None, "short", long, ""]), (2, None), (3, []), (None, [long * 20])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "request_id long, texts array<string>, piece string")
    got = split_elements(df).collect()
    by = defaultdict(list)
    for r in got:
        by[r.request_id, r.text_pos].append(r)
    assert set(by) == {(1, 2), (None, 0)}
    for key, want in (((1, 2), long), ((None, 0), long * 20)):
        p = sorted(by[key], key=lambda r: r.piece_no)
        assert "".join(r.piece[r.overlap :] for r in p) == want and max(len(r.piece) for r in p) <= 2000
        assert [r.piece_no for r in p] == list(range(len(p)))
    assert split_elements(df.limit(0)).count() == 0
    assert {(r.request_id, r.text_pos) for r in split_elements(df, only_split=False).collect()} == {(1, 1), (1, 2), (1, 3), (None, 0)}


def test_pack_windows_places_everything_once():
    rng = np.random.default_rng(7)
    sizes = np.concatenate([rng.integers(1, 60, 900), np.full(40, 64), [100, 100]])
    src = rng.integers(0, 3, len(sizes))
    share = np.bincount(src, sizes) / sizes.sum()
    deficits = np.zeros(3)
    windows = pack_windows(sizes, src, 100, share, deficits)
    flat = [i for w in windows for i in w]
    assert sorted(flat) == list(range(len(sizes))) and all(sizes[w].sum() <= 100 for w in windows)
    assert len(windows) <= 1.03 * math.ceil(sizes.sum() / 100)


def test_packed_windows(spark):
    rng = np.random.default_rng(3)
    words = ["alpha ", "beta ", "gamma "]
    rows = [(i, "".join(rng.choice(words, rng.integers(1, 60))), ["A", "a ", "b-c", None][i % 4]) for i in range(400)]
    rows += [(900, "delta " * 700, "a"), (901, None, "a"), (902, "", "b-c"), (903, "x " * 64, "zzz")]
    df = spark.createDataFrame(rows, DOCS).repartition(4)
    got = packed_windows(df, 128).collect()
    tok = load(POSITION_TOKENIZER)
    n = {i: len(tok.encode(t or "", add_special_tokens=False).ids) for i, t, _ in rows}
    have = defaultdict(int)
    for r in got:
        have[r.doc_id] += r.n_tokens
    assert dict(have) == {i: x for i, x in n.items() if x}
    assert all(c == 1 for c in Counter((r.doc_id, r.piece) for r in got).values())
    assert {r.doc_id for r in got if r.piece > 0} == {i for i, x in n.items() if x > 128}
    fill = defaultdict(int)
    for r in got:
        fill[r.window_id] += r.n_tokens
    assert max(fill.values()) <= 128 and len(fill) <= 1.05 * math.ceil(sum(n.values()) / 128) + 1
    assert packed_windows(df.limit(0), 128).count() == 0
    # wanted proportions hold in the windows while all sources last
    two = spark.createDataFrame([(i, "word " * 4, "ab"[i % 2]) for i in range(600)], DOCS).coalesce(1)
    per = defaultdict(Counter)
    for r in packed_windows(two, 64, {"a": 0.75, "b": 0.25}).collect():
        per[r.window_id][r.source] += r.n_tokens
    mixed = [w for w in per.values() if w["b"] and w["a"]]
    assert len(mixed) > 10 and 0.6 < sum(w["a"] for w in mixed) / sum(sum(w.values()) for w in mixed) < 0.9


def test_counts_agree_between_tokenizer_files():
    one, two = encoder(DEFAULT_TOKENIZER), encoder(POSITION_TOKENIZER)
    for t in ("", "plain words, and more", "é" * 50, " \t\n  x", "<|endoftext|>", "日本語 текст 123's"):
        assert one(t) == two(t)


def test_deficits_hold_over_any_stretch():
    rng = np.random.default_rng(4)
    size, src = rng.integers(5, 900, 3000), rng.choice(3, 3000, p=[0.6, 0.3, 0.1])
    share = np.bincount(src, size) / size.sum()
    windows = pack_windows(size, src, 2048, share, np.zeros(3))
    placed = np.array([np.bincount(src[w], size[w], 3) for w in windows])
    assert sorted(i for w in windows for i in w) == list(range(3000)) and size.sum() / 2048 / len(windows) > 0.97
    off = placed.cumsum(0) - share * placed.sum(1).cumsum()[:, None]
    assert np.abs(off).max() < 2 * 2048


def test_documents_that_pair_with_none_go_through_no_further_round(spark, monkeypatch):
    from nearfield.llm import pack

    names = []
    monkeypatch.setattr(pack, "persist_table", lambda df, name: names.append(name) or persist_table(df, name))
    rows = [(i, "word " * (70 + i % 3), "s") for i in range(300)]  # 70 to 72 tokens, no two in 128
    got = packed_windows(spark.createDataFrame(rows, DOCS), 128, block_rows=64).collect()
    assert len({r.window_id for r in got}) == len(got) == 300 and names == ["token-counts", "packed-0"]
    # one tiny text could always fit: all windows stay open, yet every round is spread and the number of rounds is fixed
    names.clear()
    got = packed_windows(spark.createDataFrame([*rows, (900, "x", "s")], DOCS), 128, block_rows=64, rounds=2).collect()
    assert len({r.window_id for r in got}) == 300 and len(got) == 301 and len(names) == 4
    report = window_report(packed_windows(spark.createDataFrame(rows, DOCS), 128)).collect()
    assert [(r.source, r.share, r.mean_gap) for r in report] == [("s", 1.0, 0.0)]


def test_mixture(spark):
    rows = [(i, "some words of text here", "big") for i in range(3000)] + [(5000 + i, "some words of text here", "Small ") for i in range(300)]
    rows += [(9000, "x", None), (9001, "y", "other"), (9002, None, "big"), (9003, "", "big")]
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.4, 5), ("absent", 0.1, 3), (None, 0.2, 1)], "source string, target_share double, max_repeats int")
    copies, report = mixture(spark.createDataFrame(rows, DOCS), targets)
    rep = {r.source: r for r in report.collect()}
    assert rep["small"].rate == pytest.approx(5) and rep["big"].rate == pytest.approx(0.625) and rep["absent"].actual_share == 0
    assert abs(rep["small"].actual_share - rep["small"].wanted_share) < 0.02 and rep["small"].wanted_share == pytest.approx(4 / 9)
    got = Counter(r.doc_id for r in copies.collect())
    assert all(c == 5 for d, c in got.items() if 5000 <= d < 9000) and max(c for d, c in got.items() if d < 5000) == 1 and not set(got) & {9000, 9001, 9002, 9003}
    _, capped = mixture(spark.createDataFrame(rows, DOCS), targets, total_tokens=1e9)
    assert {r.source: r.rate for r in capped.collect()} == {"big": 1.0, "small": 5.0, "absent": 0.0}
    assert mixture(spark.createDataFrame([], DOCS), targets)[0].count() == 0


CLEAN = {
    "es": ["La versión rechaza las líneas vacías.", "El próximo año habrá que reconstruir la migración.", "¿Qué pasó con la búsqueda?", "Según la información, el café está aquí."],
    "fr": ["Le coût estimé s’élève à 40 € par mois.", "La requête a été déplacée, puis exécutée.", "Où est passée la note sur le déménagement ?"],
    "de": ["Die Ähnlichkeit lag knapp über der Grenze.", "Wir müssen die Vektoren prüfen, bevor wir sie löschen.", "Größere Texte werden gekürzt."],
    "ru": ["Никто не знает, почему пространство считается новым.", "Контрольная сумма относится к копии.", "Ответ занял много времени после перезапуска."],
    "pl": ["Zgłoszenie zamknięto mimo błędów, później otwarto ponownie.", "Część wektorów jest już nieaktualna.", "Użytkowniczka woli krótsze odpowiedzi i źródła."],
    "ja": ["利用者は短い回答を好み、出典も求めている。", "同じ内容のメモが二つあるため、新しい方を残す。"],
    "en": ["The user said “must not” and left; it didn’t matter…", "Two notes — one café."],
}
SENTENCES = [s for v in CLEAN.values() for s in v]


@pytest.fixture(scope="module")
def model():
    return train(SENTENCES, known_least=1)


@pytest.mark.parametrize("chain", [c for c in CHAINS if c.split(">")[1] in ("cp1252", "latin_1", "mac_roman", "cp437", "cp850", "cp1251", "cp1250") and not c.startswith("swap")])
def test_utf8_read_wrongly_is_restored(model, chain):
    det = Detector(model)
    for s in SENTENCES:
        bad = garble(s, chain)
        if bad != s:
            text, how, _ = det.restore("Plain words first. " + bad)
            assert how and text == "Plain words first. " + s


@pytest.mark.parametrize("chain, lang", [("swap:cp1251>cp1252", "ru"), ("swap:koi8_r>cp1251", "ru"), ("swap:mac_roman>cp1252", "fr"), ("swap:iso8859_2>cp1252", "pl"), ("swap:cp932>latin_1", "ja")])
def test_swapped_encodings_are_found(model, chain, lang):
    det = Detector(model, in_use=0)
    for s in CLEAN[lang]:
        bad = garble(s, chain)
        text, how, _ = det.restore(bad)
        assert how and text != bad


def test_intact_texts_stay(model):
    det = Detector(model)
    intact = [*SENTENCES, "Map key: ÅÄÖ, ØRE, Ñ, ß.", "Sticker text: Καλή όρεξη, ÂMBAR, MAÇÃ.", "The viewer printed \"Ã©\" where the note has \"é\".", "La consola mostraba «Ã©» en vez de «é».", "The font draws \"�\" instead.", "AÑO EN REVISIÓN", "├───┼───┤", "BÂTIMENT CÔTÉ COUR", "「ÉTÉ»", "mem:14 — The cost estimate is about 5 per month."]
    for s in intact:
        assert det.restore(s) == (s, [], []), s
    assert det.process(intact) == [(s, [], []) for s in intact]


def test_garbled_places_inside_other_text(model):
    det = Detector(model)
    for chain in ("utf8:utf_8>mac_roman", "utf8:utf_8>cp437"):
        word, after = "同じ内容のメモ", "が二つあるため、新しい方を残す。"
        text, how, _ = det.restore(garble(word, chain) + after)
        assert how and text == word + after
    assert det.restore("A stray \x8d control character.")[2] == ["lost"] and det.restore("A next line\x85here.") == ("A next line\x85here.", [], [])


def test_scores_of_many_texts_are_those_of_each(model):
    texts = ["é", "", "plain", "a\0é", *SENTENCES] * 60
    many = model.scores(texts)
    assert all(np.allclose(model.scores([t])[0], row, atol=1e-3) for t, row in list(zip(texts, many))[:40])
    assert not many[1].any() and not many[2].any()


def test_corpus_statistics(spark):
    df = spark.createDataFrame([(i, "Größere Texte: l’été, ÉTÉ…" if i < 4 else None) for i in range(6)] + [(9, "")], "doc_id long, text string")
    known, counts = corpus_statistics(df)
    assert known == set("öß’éÉ…") and counts.sum() == 4 * 4
    assert all(counts[word_bucket(w)] == 4 for w in ("größere", "Texte", "l’été", "été"))
    none = corpus_statistics(df.limit(0))
    assert none[0] == set() and not none[1].any()


def test_restore_encoding(spark, model):
    rows = [(1, "La versiÃ³n rechaza las lÃ­neas vacÃ­as."), (2, "La versión rechaza."), (3, None), (4, ""), (5, "plain"), (6, "D�plac� souvent."), (7, garble(garble("Où est la requête", "utf8:utf_8>cp1252"), "utf8:utf_8>cp1252"))]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, chains string")
    got = {r.doc_id: r for r in restore_encoding(df, model).collect()}
    assert set(got) == {1, 6, 7} and got[1].restored == "La versión rechaza las líneas vacías." and got[6].is_lossy and not got[1].is_lossy
    assert got[7].restored == "Où est la requête"
    assert restore_encoding(df.limit(0)).count() == 0
