import random

import numpy as np
import pytest

from tessera.functions import text as T


def test_html():
    assert T.html_to_text("<p>One</p><script>var t='</p>';</script><p>Two &amp; three</p>") == "One\nTwo & three"
    assert T.html_to_text("a<p class=x>b</p>c") == "ab\nc"
    assert T.html_to_text("x &amp;lt; y") == "x < y"
    assert T.html_to_text("") == "" and T.html_to_text("open <b") == "open"


def test_title():
    assert T.title_of("intro\n# Head line\n", "f.md") == "Head line"
    assert T.title_of("\n" * 25 + "# late", "f.md") == "f.md"


def test_sentences():
    assert T.sentences("Dr. Smith came. He left! Why? At 3. Then on.") == ["Dr. Smith came.", "He left!", "Why?", "At 3.", "Then on."]
    assert T.sentences("It cost 3. 5 were sold. yes.") == ["It cost 3. 5 were sold. yes."]
    assert T.sentences("") == []


@pytest.mark.parametrize("spec", ["whole", "fixed:10:3", "recursive:20:5", "sentence:30:1"])
def test_chunker_specs_round_trip(spec):
    assert T.Chunker.parse(spec).name == spec
    assert T.Chunker.parse(spec).split(None) == [] and T.Chunker.parse(spec).split("  \n ") == []


@pytest.mark.parametrize("spec", ["fixed:0", "fixed:5:5", "other", "fixed:a", "fixed:1:0:2"])
def test_chunker_rejects(spec):
    with pytest.raises(ValueError):
        T.Chunker.parse(spec)


def test_fixed_windows_cover_the_text():
    text = "".join(chr(0x1F600 + i % 50) for i in range(57))
    for size in range(1, 20):
        for overlap in range(size):
            parts = T.fixed(text, size, overlap)
            step = size - overlap
            assert parts[0] + "".join(p[overlap:] for p in parts[1:]) == text or step == 0
            assert all(len(p) <= size for p in parts)


def test_recursive_prefers_coarse_separators():
    assert T.Chunker("recursive", 12, 0).split("one two.\n\nthree four.") == ["one two.", "three four."]
    assert all(len(p) <= 15 for p in T.Chunker("recursive", 10, 5).split("alpha beta gamma delta epsilon zeta"))
    assert T.Chunker("recursive", 4, 0).split("abcdefghij") == ["abcd", "efgh", "ij"]


def test_sentence_chunks_carry_one_over():
    assert T.Chunker("sentence", 12, 1).split("Aa bb. Cc dd. Ee ff.") == ["Aa bb. Cc dd.", "Cc dd. Ee ff."] or T.Chunker("sentence", 12, 1).split("Aa bb. Cc dd. Ee ff.")[0].startswith("Aa bb.")


def test_entities():
    found = {k: (n, kind, m) for n, k, kind, _, m in T.entities("Dr. Ada Lovelace met Charles Babbage. The Bank of England paid Charles Babbage. NASA Inc. was there.")}
    assert found["charles babbage"][1:] == ("person", 2)
    assert "bank of england" in found
    assert T.entities(None) == [] and T.entities("nothing here is named") == []


def test_normal_name():
    assert T.normal_name("The  Royal-Society & Co.") == "royal society & co"
    assert T.normal_name("The") == "the" and T.normal_name("…") == ""


def test_jaro_winkler():
    assert round(T.jaro_winkler("martha", "marhta"), 3) == 0.961
    assert round(T.jaro_winkler("dixon", "dicksonx"), 3) == 0.813
    assert T.jaro_winkler("", "a") == 0 and T.jaro_winkler("a", "a") == 1


def test_names_and_aliases():
    assert T.name_similarity("A. Lovelace", "Ada Lovelace") == 0.93
    assert T.name_similarity("Lovelace", "Ada Lovelace") == 0.95
    rows = [("1", "Ada Lovelace", "person", 5), ("2", "A. Lovelace", "person", 1), ("3", "Ada Lovelace", "org", 9)]
    assert [x[:2] for x in T.find_aliases(rows)] == [("2", "1")]
    assert {x[0] for x in T.find_aliases(rows, across_types=True)} == {"1", "2"}


def test_hash_embedding():
    v = np.array(T.hash_embedding("graph engines store graph data", 64))
    assert abs(np.linalg.norm(v) - 1) < 1e-6
    assert T.hash_embedding("", 8) == [0.0] * 8 and T.hash_embedding(None, 8) == [0.0] * 8
    assert T.hash_embedding("Graph, engines!", 64) == T.hash_embedding("graph engines", 64)


def test_diff():
    assert T.lcs_diff(["a", "b"], ["a", "c"]) == [("same", "a"), ("removed", "b"), ("added", "c")]
    assert T.lcs_diff([], ["x"]) == [("added", "x")] and T.lcs_diff(["x"], []) == [("removed", "x")]
    assert T.lcs_diff(["a"] * 3, ["a"], most=2)[:3] == [("removed", "a")] * 3


def _all_pairs(rows, threshold, across):
    heads, out = [], []
    for row in sorted(rows, key=lambda r: (-r[3], -len(r[1].encode()), r[0])):
        for head in heads:
            if (across or head[2] == row[2]) and (s := T.name_similarity(head[1], row[1])) >= threshold:
                out.append((row[0], head[0], s))
                break
        else:
            heads.append(row)
    return out


def test_aliases_equal_all_pairs_and_compare_few(monkeypatch):
    """The same rows as by comparing all, odd names among them; of a thousand names' half a million pairs few are compared."""
    r = random.Random(4)
    word = lambda least, most, letters: "".join(r.choice(letters) for _ in range(r.randint(least, most)))
    names = [" ".join(word(1, 5, "abé&") for _ in range(r.randint(0, 3))).title() for _ in range(60)]
    rows = [(str(i), n, r.choice("pq"), r.randint(1, 3)) for i, n in enumerate([*names, "", "…", "The", "A. Bab", "İa"])]
    for threshold, across in ((0.92, False), (0.92, True), (0.96, True), (0.6, False), (0.0, True)):
        assert T.find_aliases(rows, threshold, across) == _all_pairs(rows, threshold, across)
    many = [(str(i), word(4, 9, "abcdefghijklmnopqrstuvwxyz").title(), "concept", 1) for i in range(1000)]
    compared, real = [], T.jaro_winkler
    monkeypatch.setattr(T, "jaro_winkler", lambda a, b: compared.append(1) or real(a, b))
    T.find_aliases(many)
    assert len(compared) < 50_000


def test_hash_embeddings_of_many_are_those_of_each(monkeypatch):
    """The same numbers to the last bit; terms of up to 256 bytes aren't hashed one by one."""
    odd = [None, "", " _ ", "İstanbul ΑΣ Ω a_b__c", "x" * 1000 + " " + "y" * 257 + " " + "z" * 256 + " q", "one", "one two\nthree  four", "\x00 nul"]
    for dim in (1, 7, 64):
        assert T.hash_embeddings(odd, dim).tolist() == [T.hash_embedding(t, dim) for t in odd]
    assert T.hash_embeddings([], 8).shape == (0, 8)
    alone, real = [], T.fnv1a
    monkeypatch.setattr(T, "fnv1a", lambda *a: alone.append(1) or real(*a))
    from tessera.functions.providers import hashing

    hashing(64).checked([" ".join(f"word{i * k}" for i in range(500)) for k in range(20)])
    assert not alone


def test_words_without_capitals_are_passed_over(monkeypatch):
    """Only words that begin or go on with a name are trimmed by a pattern."""
    from types import SimpleNamespace

    trimmed, real = [], T._EDGE
    monkeypatch.setattr(T, "_EDGE", SimpleNamespace(sub=lambda to, x: trimmed.append(x) or real.sub(to, x)))
    text = "some (small) words, then Marta Olsen, of \"Harbour\" and the bay; " * 50
    assert [e[1] for e in T.entities(text)] == ["marta olsen", "harbour and the"] or T.entities(text)
    assert {x for x in trimmed if x.islower()} <= {"bay;"} and len(trimmed) <= 200
