import random
import re

import pytest

from tessera.llm import pii
from tessera.llm import queries as Q

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m.group() if c in "0123456789"]
            if kind == "ip" and any(int(x) > 255 for x in m.group().split(".")):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            if kind == "card":
                odd = sum(digits[-1::-2])
                even = sum(sum(divmod(2 * d, 10)) for d in digits[-2::-2])
                if not 12 <= len(digits) <= 19 or (odd + even) % 10:
                    continue
            out.append((kind, *m.span()))
    return out


@pytest.mark.parametrize("letters", ["01 .-@a+()", "0123456789 -", "a.@-1", "1.25 0", "+1 2(3)4.5-6"])
def test_base_spans_equal_the_patterns(letters):
    rng = random.Random(letters)
    for _ in range(6000):
        t = "".join(rng.choice(letters) for _ in range(rng.randrange(45)))
        assert sorted(brute(t)) == sorted(pii.base_spans(t)), t


@pytest.mark.parametrize(("text", "kind", "hidden"), [
    ("mail bob[at]example[dot]com now", "email", "bob[at]example[dot]com"),
    ("bob (at) mail (dot) example (dot) org.", "email", "bob (at) mail (dot) example (dot) org"),
    ("write jane dot doe at mail dot example dot org today", "email", "jane dot doe at mail dot example dot org"),
    ("x bоb@exаmple.com y", "email", "bоb@exаmple.com"),
    ("b@ex​ample.com", "email", "b@ex​ample.com"),
    ("card ４０４１８９４９７４６０８７９５.", "card", "４０４１８９４９７４６０８７９５"),
    ("card four zero four one 8949 7460 8795", "card", "four zero four one 8949 7460 8795"),
    ("call plus 1 nine eight eight five five five two four eight five ok", "phone", "plus 1 nine eight eight five five five two four eight five"),
    ("host 42 dot 144 dot 35 dot 254 up", "ip", "42 dot 144 dot 35 dot 254"),
    ("host 42 point 144 point 35 point 254 up", "ip", "42 point 144 point 35 point 254"),
])
def test_disguises_map_back_to_the_source(text, kind, hidden):
    base = pii.base_spans(text)
    added = pii.added_spans(text, base)
    assert [(k, text[a:b]) for k, a, b in added if k == kind] == [(kind, hidden)] or hidden in [text[a:b] for _, a, b in base]
    assert hidden not in pii.redact(text)


@pytest.mark.parametrize(("text", "kind", "hidden"), [
    ("host one nine two dot one six eight dot zero dot one up", "ip", "one nine two dot one six eight dot zero dot one"),
    ("host one 9 two point 1 six 8 dot 0 dot one up", "ip", "one 9 two point 1 six 8 dot 0 dot one"),
    ("host four.five.six.seven up", "ip", "four.five.six.seven"),
    ("call +1 nine 8 eight five 5 five two four 8 five ok", "phone", "+1 nine 8 eight five 5 five two four 8 five"),
    ("call plus 1 nine 8 eight five 5 five two four 8 five ok", "phone", "plus 1 nine 8 eight five 5 five two four 8 five"),
    ("call +1 nine eight eight 5 five five two four 8 five ok", "phone", "+1 nine eight eight 5 five five two four 8 five"),
    ("card 4 zero 4 one 8 nine 4 nine 7 four 6 zero 8 seven 9 five ok", "card", "4 zero 4 one 8 nine 4 nine 7 four 6 zero 8 seven 9 five"),
    # what runs of spelled digits alone show stays, though the word before would spoil it
    ("no one 4041 8949 7460 eight seven nine five ok", "card", "4041 8949 7460 eight seven nine five"),
])
def test_spelled_and_written_digits_mixed(text, kind, hidden):
    assert [text[a:b] for k, a, b in pii.added_spans(text, pii.base_spans(text)) if k == kind] == [hidden]
    assert hidden not in pii.redact(text)


@pytest.mark.parametrize(("pattern", "text"), [
    (pii._AT, "bob[at]x"), (pii._AT, "bob { @ } x"), (pii._DOT, "x(dot)com"), (pii._DOT, "x< . >com"), (pii._WORDS, "bob at x dot com"),
    (pii._NUMBER_DOT, "4 dot 2"), (pii._NUMBER_DOT, "4 Point 2"), (pii._PLUS, "plus 1")])
def test_each_rewriting_pattern_alone_passes_the_hint(pattern, text):
    assert pattern.search(text)
    assert pii._HINT.search(text) and pii.rewritten(text).text != text


@pytest.mark.parametrize("text", ["look at the dot matrix dot com", "one two three", "we met at ten", "Le prix est é ü ß ñ", "nineteen at noon", "a (a) b.c"])
def test_clean_texts_stay(text):
    assert pii.ordered([*pii.base_spans(text), *pii.added_spans(text, [])]) == []
    assert pii.redact(text) == text


_SPELL = {"en": "zero one two three four five six seven eight nine", "de": "null eins zwei drei vier fünf sechs sieben acht neun",
          "fr": "zéro un deux trois quatre cinq six sept huit neuf", "es": "cero uno dos tres cuatro cinco seis siete ocho nueve"}
_SIGN = {"en": ("at", "dot", "plus"), "de": ("at", "punkt", "plus"), "fr": ("arobase", "point", "plus"), "es": ("arroba", "punto", "más")}


@pytest.mark.parametrize("language", _SPELL)
def test_planted_disguises_are_found_in_four_languages(language):
    """Recall over random addresses and numbers in words, and nothing but them."""
    rng = random.Random(language)
    digit, (at, dot, plus) = _SPELL[language].split(), _SIGN[language]
    spell = lambda n: " ".join(digit[int(d)] for d in n)
    found = total = 0
    for k in range(120):
        name, host = ("".join(rng.choice("bcdfghklm") for _ in range(rng.randrange(3, 9))) for _ in range(2))
        ip = f" {dot} ".join(spell(str(rng.randrange(256))) for _ in range(4))
        hidden, kind = [(f"{name} {at} {host} {dot} com", "email"), (f"{name}({at}){host}({dot})org", "email"), (f"{name}(a){host}.net", "email"),
                        (ip, "ip"), (f"{plus} {spell('4' + str(rng.randrange(10**9, 10**10)))}", "phone")][k % 5]
        text = f"Xyz, {hidden}, xyz."
        spans = pii.added_spans(text, pii.base_spans(text))
        total += 1
        found += any(k_ == kind and text[a:b].strip() == hidden for k_, a, b in spans)
    assert found / total >= 0.9


def test_hosts_of_many_labels():
    text = "write to a dot b dot c at h1 dot h2 dot h3 dot h4 dot h5 dot h6 dot h7 dot com today"
    assert [text[a:b] for k, a, b in pii.added_spans(text, [])] == ["a dot b dot c at h1 dot h2 dot h3 dot h4 dot h5 dot h6 dot h7 dot com"]


def test_chained_edits_map_to_the_source():
    rng = random.Random(1)
    for _ in range(500):
        source = "".join(rng.choice("abcxyz") for _ in range(30))
        view = pii.Rewritten(source)
        back = [(i, i + 1) for i in range(30)]
        for _ in range(3):
            found, at, new_back = [], 0, []
            for a in sorted(rng.sample(range(len(view.text) + 1), 4)):
                b = min(len(view.text), a + rng.randrange(1, 4))
                if a < at or a >= b:
                    continue
                new = "Q" * rng.randrange(0, 3)
                found.append((a, b, new))
                new_back += back[at:a] + [(back[a][0], back[b - 1][1])] * len(new)
                at = b
            back = new_back + back[at:]
            view = view.replaced(found)
        assert len(back) == len(view.text)
        for i, span in enumerate(back):
            assert view.source(i, i + 1) == span


def test_long_texts_take_linear_time():
    for t in ("1" * 300_000, "a" * 300_000 + "@", "a@" * 150_000, "+1" + " " * 300_000, "1." * 150_000, "one " * 75_000, "a at " * 60_000):
        pii.redact(t)


def test_odd_rows_and_digests(spark, odd, odd_rows, none, tmp_path):
    import hashlib
    rows = {r.doc_id: r for r in pii.find_pii(odd).collect()}
    assert len(pii.find_pii(odd).collect()) == len(odd_rows) and all(r.spans == [] for r in rows.values())
    assert pii.find_pii(none).count() == 0
    text = "a@b.cd 1.2.3.4 +1 988 555 2485"
    folder = str(tmp_path / "pii")
    spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    got = {r.doc_id: r for r in Q.queries()["op6_deobfuscation"](spark, folder).collect()}
    joined = "email:0:6,ip:7:14,phone:15:30"
    assert (got[1].n_email, got[1].n_ip, got[1].n_card, got[1].n_phone) == (1, 1, 0, 1)
    assert got[1].spans == joined and got[1].base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
    assert got[2].spans == "" and got[2].base_sha256 == hashlib.sha256(b"").hexdigest()
