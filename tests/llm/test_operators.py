"""Substring dedup, chat formatting, personal data, pieces and fingerprints against brute force; edge cases of each."""

import base64
import hashlib
import itertools
import math
import random
import re
import sys
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from vellum.llm import chat, pieces, pii, spotsigs, substring_dedup

MODEL = public_tokenizers.path("piece_bpe_32k.model")
CLASH = "doc_id long, text string, row int, words string, place int, terms string, base string"
EDGES = [(d, t, 1, "x", 2, None, "y") for d, t in [(1, None), (2, ""), (None, "plain words here"), (3, "plain words"), (3, "plain words"), (4, "long text, yes. " * 8000), (5, " \n\t"), (-7, "é 日本 🎉")]]


@pytest.mark.parametrize("operator", [
    substring_dedup.remove_repeats, pii.find_personal_data, pii.sanitise, lambda d: pieces.encode_documents(d, MODEL), spotsigs.fingerprints, spotsigs.with_edits,
])
def test_edges(spark, operator):
    docs = spark.createDataFrame(EDGES, CLASH)
    assert operator(docs.limit(0)).collect() == []
    got = operator(docs).collect()
    assert sorted(map(repr, (r.doc_id for r in got))) == sorted(repr(row[0]) for row in EDGES)


# --- substring dedup ---------------------------------------------------------------------------------------------------


def brute_repeats(docs):
    """Removed sentences by document, from all pairs of runs."""
    runs, split = [], {}
    for doc_id in sorted(docs):
        parts = []
        for piece in re.findall(r"[^.!?,\n]*(?:[.!?,\n]+[ \t\n\x0b\x0c\r]*)|[^.!?,\n]+$", docs[doc_id]):
            if parts and not piece.strip():
                parts[-1] += piece
            else:
                parts.append(piece)
        split[doc_id] = parts
        for k in range(len(parts)):
            for n in range(2, len(parts) - k + 1):
                key = tuple(tuple(p.lower().split()) for p in parts[k : k + n])
                if sum(map(len, key)) >= 20:
                    runs.append((key, doc_id, k))
    first, gone = {}, {d: set() for d in docs}
    for key, doc_id, k in runs:
        if first.setdefault(key, (doc_id, k)) != (doc_id, k):
            gone[doc_id] |= set(range(k, k + len(key)))
    return {d: "".join(p for k, p in enumerate(split[d]) if k not in gone[d]) for d in docs}


def test_substring_dedup(spark):
    r = random.Random(4)
    vocabulary = [f"w{i}" for i in range(60)]
    sentence = lambda: " ".join(r.choice(vocabulary) for _ in range(r.randrange(2, 9))) + r.choice([". ", "! ", ", ", "\n", "?  "])
    passages = [[sentence() for _ in range(r.randrange(3, 12))] for _ in range(6)]
    docs = {}
    for d in range(60):
        parts = [sentence() for _ in range(r.randrange(0, 12))]
        for _ in range(r.randrange(0, 3)):
            at = r.randrange(len(parts) + 1)
            passage = list(r.choice(passages))
            parts[at:at] = [p.upper() if r.random() < 0.2 else p for p in passage]
        docs[d * 3] = "".join(parts) + ("tail without an end" if d % 5 == 0 else "")
    got = {x.doc_id: x for x in substring_dedup.remove_repeats(spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(4)).collect()}
    want = brute_repeats(docs)
    assert {d: got[d].text for d in docs} == want
    assert all(got[d].removed_chars == len(docs[d]) - len(want[d]) for d in docs) and sum(x.n_removed for x in got.values()) > 50


def brute_all_runs(docs):
    """Removed text by document, from every run of at least 2 pieces and 20 words."""
    first, gone, runs = {}, {d: set() for d in docs}, []
    split = {d: substring_dedup.pieces_of(docs[d])[0] for d in docs}
    for d in sorted(docs):
        words = [tuple(p.lower().split()) for p in split[d]]
        for k in range(len(words)):
            for end in range(k + 2, len(words) + 1):
                if sum(map(len, words[k:end])) >= 20:
                    key = tuple(words[k:end])
                    first.setdefault(key, (d, k))
                    runs.append((key, d, k, end))
    for key, d, k, end in runs:
        if first[key] != (d, k):
            gone[d] |= set(range(k, end))
    return {d: "".join(p for k, p in enumerate(split[d]) if k not in gone[d]) for d in docs}


def test_substring_dedup_finds_all_runs(spark):
    r = random.Random(8)
    sentence = lambda n: " ".join(f"w{r.randrange(300)}" for _ in range(n)) + ". "
    passages = [[sentence(r.choice([1, 3, 8, 15, 15, 30])) for _ in range(r.randrange(2, 7))] for _ in range(8)]
    docs = {d: "".join(s for _ in range(3) for s in [sentence(r.randrange(1, 12)), *r.choice(passages)[r.randrange(2) :]]) for d in range(30)}
    tail = "".join(map(sentence, (15, 15, 15, 3)))
    inner = sentence(60).removesuffix(". ")
    docs |= {100: tail, 101: tail, 102: f"before it {inner} and so on", 103: f"other words lead here {inner} then something else"}
    got = {x.doc_id: x for x in substring_dedup.remove_repeats(spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3)).collect()}
    assert {d: got[d].text for d in docs} == brute_all_runs(docs)
    assert (got[101].text, got[101].n_sentences, got[101].n_removed) == ("", 4, 4)
    assert got[102].text == docs[102] and len(got[103].text.split()) < 30 and got[103].n_removed == 0
    assert all("".join(substring_dedup.pieces_of(t)[0]) == t for t in [*docs.values(), " \n", "", " " * 50, "  lead " + "a " * 40 + "\n\n  x"])


def test_substring_dedup_calls():
    """A text's runs take few calls from Python for each piece, as hashes of pieces are summed up by numpy; with a hash of each run they took 22."""
    r = random.Random(9)
    text = "".join(" ".join(f"w{r.randrange(300)}" for _ in range(r.randrange(1, 12))) + ". " for _ in range(2000))
    calls = []
    sys.setprofile(lambda frame, event, arg: calls.append(event) if event in ("call", "c_call") else None)
    try:
        batch = pa.RecordBatch.from_pydict({"doc_id": [1], "text": [text]})
        list(substring_dedup._emit(iter([batch])))
    finally:
        sys.setprofile(None)
    assert len(calls) < 12 * 2000, len(calls)


# --- chat ---------------------------------------------------------------------------------------------------------------


def test_chat_round_trip(spark):
    odd = ["<|im_end|>", "<\\|im_end|>", "<|n|>\n<|im_start|>assistant ok", "<<\\\\|", "", None, "é\n\n日本", "<|" * 500]
    rows = [(c, t, role, odd[(c * 3 + t) % len(odd)], "k") for c in range(12) for t, role in enumerate(["system", "user", "assistant", "user", "assistant", None, "as\nsistant<|"][: 1 + c % 7])]
    rows += [(77, t, role, "<|im_end|> é" * 60000, "k") for t, role in enumerate(["user", "assistant", "assistant"])]
    rows += [(99, 0, "assistant", "twice", "k"), (99, 0, "assistant", "twice", "k"), (None, 1, "user", "x", "k")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string").repartition(3)
    got = {r.conv_id: r for r in chat.digest(df).collect()}
    groups = {}
    for c, t, role, text, _ in rows:
        groups.setdefault(c, []).append((t, role or "", text or ""))
    assert set(got) == set(groups)
    for c, turns in groups.items():
        turns.sort()
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        said = "".join(text for _, role, text in turns if role == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256) == (len(turns), sha("".join(f"{role}\n{text}\n" for _, role, text in turns)))
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(said), sha(said))
    formatted = chat.format_conversations(df)
    whole = {r.conv_id: r.formatted for r in formatted.collect()}
    for x in chat.expand(formatted).collect():
        if x.example is not None:
            assert whole[x.conv_id].startswith(x.text) and len(x.text) == x.loss_start + x.loss_chars + len(chat.END) + 1
    for c, turns in groups.items():
        assert whole[c].count("<|im_start|>") == len(turns) == whole[c].count("<|im_end|>")
    assert chat.digest(df.limit(0)).collect() == []


# --- personal data --------------------------------------------------------------------------------------------------------


def luhn(digits):
    total = 0
    for k, d in enumerate(reversed([int(x) for x in digits])):
        d = d * 2 if k % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def brute_personal(text):
    spans = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    spans += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            spans.append((m.start(), 2, m.end()))
    spans += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(spans)


def random_text(r, n):
    bits = ["a@b.co", "@", "@@", ".", "..", "1", "255", "256", "0001", "4111 1111 1111 1111", "+", "+1 (555) 010-9999", "-", " ", "x", "é", "@x", "a.b", "%", "4111-1111-1111-1112", "12.34.56.78", "日"]
    return "".join(r.choice(bits) for _ in range(n))


def test_personal_base_spans(spark):
    r = random.Random(6)
    texts = [random_text(r, r.randrange(0, 30)) for _ in range(400)]
    got = {x.doc_id: x for x in pii.find_personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for d, text in enumerate(texts):
        want = brute_personal(text)
        spelled = [f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in want]
        assert [x for x in got[d].spans.split(",") if x and not x.startswith("term")] == spelled, text
        assert got[d].base_sha256 == hashlib.sha256(",".join(spelled).encode()).hexdigest()
        assert [got[d].n_email, got[d].n_ip, got[d].n_card, got[d].n_phone] == [sum(k == x[1] for x in want) for k in range(4)]


def test_disclosing_terms(spark):
    """A word that stands near one address only, in several surroundings, gives it away; common words and single mentions do not."""
    rows = [(n, f"today {w} wrote zorblatt about plans to jane.roe@example.org before noon {w}{n}") for n, w in enumerate(["alpha", "beta", "gamma", "delta"])]
    rows += [(100 + n, f"today nobody wrote about plans before noon item{n} word{n % 7}") for n in range(60)] + [(300, "only once quuxly told pete@example.org here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spans = {x.doc_id: x.spans for x in pii.find_personal_data(docs).collect()}
    for n in range(4):
        text = rows[n][1]
        terms = [text[int(s) : int(e)] for k, s, e in (x.split(":") for x in spans[n].split(",")) if k == "term"]
        assert "zorblatt" in terms and not {"today", "plans", "noon", "before", "wrote", "about"} & set(terms)
    assert "term" not in spans[300] and spans[101] == ""
    clean = {x.doc_id: x.text for x in pii.sanitise(docs).collect()}
    assert "zorblatt" not in clean[0] and "[EMAIL]" in clean[0] and clean[101] == rows[5][1]


def brute_disclosing(texts):
    """Disclosing words by counting documents for every pair of word and entity, as the thresholds are written down."""
    word = re.compile("(?:[A-Za-z0-9]|(?![\u2000-\u203f\u3000-\u303f])[\u0080-\U0010ffff])+")
    with_term, with_entity, pairs = Counter(), Counter(), defaultdict(dict)
    for d, text in enumerate(texts):
        spans = brute_personal(text)
        words = [m for m in word.finditer(text) if len(m[0].encode()) >= 3]
        with_term.update({m[0].lower() for m in words})
        free = [m for m in words if not m[0].isdigit() and not any(s < m.end() and m.start() < e for s, _, e in spans)]
        seen = set()
        for start, kind, end in spans:
            at = sum(m.start() < start for m in free)
            near = [m[0].lower() for m in free[max(0, at - pii.NEAR_WORDS) : at + pii.NEAR_WORDS]]
            for name in pii.levels(kind, text[start:end].encode()):
                seen.add(name)
                for term in set(near):
                    pairs[name, term].setdefault(d, set()).add(" ".join(near))
        with_entity.update(seen)
    out, total = set(), max(len(texts), 2)
    for (name, term), docs in pairs.items():
        if len({min(x) for x in docs.values()}) >= pii.SUPPORT and with_entity[name] < total:
            shared = math.log(len(docs) * total / (with_term[term] * with_entity[name]))
            if shared >= pii.DISCLOSURE * math.log(total / with_entity[name]) - 1e-9:
                out.add(term)
    return out


def planted_people(n, seed=21):
    """Documents of common words; some give a person's address beside the nickname, and others the nickname alone."""
    r = random.Random(seed)
    common = [f"word{k}" for k in range(150)]
    people = [(f"zanni{k}fex", f"p{k}@mail{k}.example.com" if k % 2 else f"+1 (5{k:02d}) 555-01{k:02d}") for k in range(12)]
    out, where = [], {}
    for d in range(n):
        words = [r.choice(common) for _ in range(r.randrange(90, 140))]
        if d % 20 == 0:
            name, address = people[d // 20 % len(people)]
            at = r.randrange(10, 80)
            words[at:at] = [name, address]
            where.setdefault(name, []).append(d)
            if d % 40 == 0:
                words.append(name)
        elif d % 333 == 1:
            name = people[d % len(people)][0]
            words.insert(50, name.capitalize())
            where.setdefault(name, []).append(d)
        out.append(" ".join(words))
    return out, where


def test_disclosing_terms_of_planted_people(spark):
    texts, where = planted_people(1000)
    texts += [texts[0]] * 40  # copies of a passage count as one surrounding and as documents alike
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    want = brute_disclosing(texts)
    assert len(want & set(where)) >= 0.9 * len(where) and not any(x.startswith("word") for x in want)
    got = {x.doc_id: x.spans for x in pii.find_personal_data(docs).collect()}
    for d, text in enumerate(texts):
        terms = [text[int(s) : int(e)] for k, s, e in (x.split(":") for x in got[d].split(",") if x) if k == "term"]
        assert sorted(terms) == sorted(w for w in text.split() if w.lower() in want), d
        starts = [int(x.split(":")[1]) for x in got[d].split(",") if x]
        assert starts == sorted(starts)
    clean = {x.doc_id: x.text for x in pii.sanitise(docs).collect()}
    assert not any(name in clean[d].lower() for name in want & set(where) for d in where[name])


def test_personal_data_beside_other_scripts(spark):
    """Surroundings of whole characters: wide ones, marks of general and CJK punctuation, and none at all."""
    texts = ["a@b.co  " + "日" * 100, "日" * 90 + " a@b.co", "é" * 130 + "a@b.co" + "🎉" * 70, "「日本」a@b.co、東京。" * 30, "\u2019" * 300 + "+1 (555) 010-9999", "a@b.co"]
    rows = {x.doc_id: x for x in pii.find_personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for d, text in enumerate(texts):
        base = [f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in brute_personal(text)]
        assert [x for x in rows[d].spans.split(",") if not x.startswith("term")] == base and base
        for k, s, e in (x.split(":") for x in rows[d].spans.split(",")):
            assert 0 <= int(s) < int(e) <= len(text) and (k != "term" or not set(text[int(s) : int(e)]) & set("「」、。 @"))


def test_sanitise_goes_by_row(spark):
    rows = [(7, "mail jane@example.org now"), (7, "other row with no mail"), (None, "call +1 (555) 010-9999 today"), (7, "mail jane@example.org now")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, spans string")
    got = sorted(((x.doc_id, x.text) for x in pii.sanitise(docs).collect()), key=repr)
    assert got == sorted([(7, "mail [EMAIL] now"), (7, "other row with no mail"), (None, "call [PHONE] today"), (7, "mail [EMAIL] now")], key=repr)


# --- pieces -----------------------------------------------------------------------------------------------------------------


def brute_segmentations(model, text):
    """(score, ids) of all segmentations, best first."""
    found = []
    for cuts in itertools.product([0, 1], repeat=max(len(text) - 1, 0)):
        at = [0, *(k + 1 for k, c in enumerate(cuts) if c), len(text)]
        score, ids = 0.0, []
        for a, b in zip(at, at[1:]):
            piece = text[a:b]
            if piece in model.pieces:
                ids.append(model.pieces[piece][0])
                score += model.pieces[piece][1]
            elif b == a + 1:
                ids += [model.bytes[x] for x in piece.encode()]
                score += model.unknown
            else:
                break
        else:
            found.append((score, ids))
    return sorted(found, key=lambda x: -x[0])


def test_n_best_matches_all_segmentations():
    model = pieces.model_of(MODEL)
    r = random.Random(3)
    words = ["▁", "▁a", "▁hello", "▁the", "▁▁x", "▁日本", "▁🎉a", "▁ieschtz"] + ["▁" + "".join(r.choice("abcdehilnorstuéß") for _ in range(r.randrange(1, 10))) for _ in range(150)]
    for word in words:
        want = brute_segmentations(model, word)
        for n in (1, 3, 6):
            got = model.n_best(word, n)
            assert [round(s, 6) for s, _ in got] == [round(s, 6) for s, _ in want[:n]], word
            assert all(any(ids == list(w) and abs(s - t) < 1e-6 for t, w in want) for s, ids in got)
            assert len({tuple(ids) for _, ids in got}) == len(got)


def test_best_segmentations_mostly_agree_with_the_file(spark):
    """Most words are cut as the file's own encoder cuts them, which merges pairs and knows no probabilities."""
    import sentencepiece

    own, model = sentencepiece.SentencePieceProcessor(model_file=MODEL), pieces.model_of(MODEL)
    words = Counter(w for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect() for w in pieces.words_of(r.text or ""))
    same = sum(n for w, n in words.items() if model.n_best(pieces.SPACE + w, 1)[0][1] == own.encode(w))
    assert same >= 0.75 * sum(words.values())
    assert model.n_best("▁the▁quick▁brown", 1)[0][1] == own.encode("the quick brown")


def test_encode_documents(spark):
    texts = ["the cat sat on the mat", "  two  spaces ", "tail ", "▁ mark ▁▁", "line\nfeed\ttab", "日本語 🎉 x", "x" * 3000, "", None, " "] + [f"word{i} again the" for i in range(600)]
    rows = pieces.encode_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), MODEL, with_ids=True).collect()
    model = pieces.model_of(MODEL)
    assert len(rows) == len(texts)
    for x in rows:
        text = texts[x.doc_id] or ""
        assert x.round_trip and pieces.decode(x.ids, MODEL) == text.replace("▁", " ") and x.n_pieces == len(x.ids)
        if 0 < len(text) < 30:
            best = model.n_best(pieces.mark(text))
            assert [round(s, 4) for s, _ in best] == [round(s, 4) for s in x.scores], text

        assert x.scores == sorted(x.scores, reverse=True)
    assert [r.scores for r in rows if r.doc_id == 7] == [[0.0]]


# --- fingerprints -----------------------------------------------------------------------------------------------------------


def brute_signs(text):
    words = [w for w in re.split(r"[^\w]+|_+", text.lower()) if w]
    spots = set()
    for i, w in enumerate(words):
        if w in spotsigs.ANCHORS:
            after = [x for x in words[i + 1 : i + 1 + spotsigs.LOOK] if x not in spotsigs.ANCHORS][: spotsigs.CHAIN]
            spots.add(" ".join([w, " ".join(after)]))
    return spots if any(w in spotsigs.ANCHORS for w in words) else set(words)


def test_fingerprints(spark):
    r = random.Random(9)
    vocabulary = ["the", "of", "and", "un", "der"] + [f"word{i}" for i in range(80)]
    docs = {d * 5 - 40: " ".join(r.choice(vocabulary) for _ in range(r.choice([0, 1, 3, 20, 60, 300]))) + r.choice(["", ".", " é ß"]) for d in range(50)}
    docs[1000] = docs[-40]
    docs |= {2000 + d: docs[d * 5 - 40] + " the tail" for d in range(20)} | {3000: " ".join(r.choice(vocabulary) for _ in range(20000)), 3001: "the end"}
    got = {x.doc_id: x for x in spotsigs.with_edits(spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(5)).collect()}
    order = sorted(docs)
    for k, d in enumerate(order):
        text, following = docs[d], docs[order[(k + 1) % len(order)]]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + following[:cut]
        x = got[d]
        assert (x.n_chars, x.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        for likeness, other in ((x.near_edited, edited), (x.near_next, following)):
            a, b = brute_signs(text), brute_signs(other)
            exact = len(a & b) / len(a | b) if a | b else 1.0
            assert abs(likeness - exact) < 1e-9, (text, other)
        assert x.edited_similar == (x.near_edited >= 0.8 - 1e-9) and x.next_similar == (x.near_next >= 0.8 - 1e-9)
        size, _, packed = x.fingerprint.partition(":")
        assert int(size) == len(brute_signs(text)) == len(base64.b64decode(packed)) * 8 / spotsigs.HASH_BITS
    assert got[1000].fingerprint == got[-40].fingerprint and max(x.length_partition for x in got.values()) > 18


def test_fingerprint_search(spark):
    r = random.Random(12)
    vocabulary = ["the", "of", "and", "un", "der"] + [f"word{i}" for i in range(200)]
    docs = {}
    for _ in range(12):
        base = [r.choice(vocabulary) for _ in range(r.choice([8, 30, 90, 200]))]
        for _ in range(r.randrange(1, 9)):
            words = list(base)
            for _ in range(r.randrange(0, 1 + len(words) // 25)):
                words[r.randrange(len(words))] = r.choice(vocabulary)
            docs[len(docs)] = " ".join(words[: len(words) - r.randrange(0, 4)])
    docs[900] = ""
    df = spark.createDataFrame([*docs.items(), (None, docs[0])], "doc_id long, text string").repartition(3)
    sets = {d: brute_signs(t) for d, t in docs.items()}
    asked = [d for d in docs if d % 3 == 0]
    want = {(a, b) for a in asked for b in docs if a != b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9}
    got = spotsigs.search(df, df.where("doc_id % 3 = 0")).collect()
    assert {(x.query_id, x.doc_id) for x in got} == want and len(got) == len(want) > 20
    assert all(abs(x.similarity - len(sets[x.query_id] & sets[x.doc_id]) / len(sets[x.query_id] | sets[x.doc_id])) < 1e-9 for x in got)
    assert spotsigs.search(df.limit(0), df).collect() == [] == spotsigs.search(df, df.limit(0)).collect()


def test_a_task_counts_each_term_once(monkeypatch):
    """Term counts of the batches of a task are summed before they leave it."""
    batches = [([1, 5], [1, 2]), ([], []), ([5, 7, 9], [1, 1, 4]), ([-3, 1], [2, 2])]
    arrays = lambda: ((np.array(t, np.int64), np.array(n, np.int64)) for t, n in batches)
    assert [(t.tolist(), n.tolist()) for t, n in pii._summed(arrays())] == [([-3, 1, 5, 7, 9], [2, 3, 3, 1, 4])]
    monkeypatch.setattr(pii, "_TERMS", 3)
    parts = list(pii._summed(arrays()))
    total = Counter()
    for terms, n in parts:
        total.update(dict(zip(terms.tolist(), n.tolist(), strict=True)))
    assert len(parts) == 2 and total == {-3: 2, 1: 3, 5: 3, 7: 1, 9: 4}
