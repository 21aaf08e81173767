import hashlib
import random

import pytest

from folioloom.llm import line_chunks, units

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()


def line(rng):
    return " ".join(rng.choices(WORDS, k=rng.randrange(3, 14)))


@pytest.fixture(scope="module")
def rows():
    """Texts that share passages at shifted places, repeat lines of their own, and differ by one word."""
    rng = random.Random(8)
    passages = [[line(rng) for _ in range(rng.randrange(3, 20))] for _ in range(8)]
    out = []
    for i in range(60):
        lines = [line(rng) for _ in range(rng.randrange(6))]
        for _ in range(rng.randrange(3)):
            lines += rng.choice(passages) + [line(rng) for _ in range(rng.randrange(3))]
        if rng.random() < 0.2:
            lines += [lines[0]] * 4 if lines else []
        out.append((i if rng.random() < 0.9 else None, "\n".join(lines) + rng.choice(["", "\n"])))
    return out + [(70, None), (71, ""), (72, "\n\n\n"), (3, out[3][1]), (None, None), (73, "Alpha  BETA\t" + out[5][1])]


def spans(text):
    lines = text.split("\n")
    hashes = [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) for x in lines]
    first = 0
    for i, h in enumerate(hashes):
        if i == len(lines) - 1 or (h + 31 * (hashes[i - 1] if i else 0)) % 3 == 0:
            yield first, i + 1 - first, "\n".join(lines[first:i + 1])
            first = i + 1


def repeats(docs, found, text_hash):
    """Later occurrences: (doc_id, text, entry, kept doc_id, kept entry)."""
    groups = {}
    for i, text in set(docs):
        for key, entry in found(text or "") if text is not None else ():
            groups.setdefault(key, []).append(((i is None, i or 0, text_hash[text], entry[0]), i, text, entry))
    for group in groups.values():
        group.sort(key=lambda x: x[0])
        yield from ((i, text, entry, group[0][1], group[0][3]) for _, i, text, entry in group[1:])


@pytest.fixture(scope="module")
def hashes(spark, rows):
    texts = spark.createDataFrame([(t,) for _, t in rows], "text string")
    return {r.text: r.h for r in texts.selectExpr("text", "xxhash64(text) h").collect()}


def test_chunks(make_docs, rows, hashes):
    def found(text):
        return [(c, (f, n)) for f, n, c in spans(text) if n >= 2 and len(c.split()) >= 8]

    want = sorted(str((i, e[0], e[1], k, ke[0])) for i, _, e, k, ke in repeats(rows, found, hashes))
    got = [str(tuple(r)) for r in line_chunks.removed_chunks(make_docs(rows)).collect()]
    # Rows that repeat are one document; each of them reports its removed chunks.
    assert sorted(set(got)) == sorted(set(want)) and len(want) > 20


def test_texts_without_chunks(make_docs, rows, hashes):
    docs = make_docs(rows)
    removed = {}
    for i, text, entry, _, _ in repeats(rows, lambda t: [(c, (f, n)) for f, n, c in spans(t) if n >= 2 and len(c.split()) >= 8], hashes):
        removed.setdefault((i, text), set()).update(range(entry[0], entry[0] + entry[1]))
    got = line_chunks.without_repeated_chunks(docs)
    assert got.columns == docs.columns and got.dtypes == docs.dtypes
    assert {(r._hash, r._doc, r._text) for r in got.collect()} == {(3, 5, "u")}
    want = [(i, t if (i, t) not in removed else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in removed[i, t])) for i, t in rows]
    assert sorted(map(str, ((r.doc_id, r.text, r.n_chars) for r in got.collect()))) == sorted(str((i, t, None if t is None else len(t))) for i, t in want)


def test_boundaries_do_not_move_with_the_passage(make_docs):
    rng = random.Random(4)
    passage = [line(rng) + f" {k}" for k in range(40)]
    docs = make_docs([(1, "\n".join(passage)), (2, "\n".join([line(rng), "x", *passage, "y"]))])
    got = [r.n_lines for r in line_chunks.removed_chunks(docs).collect()]
    assert sum(got) >= 25


def unit_entries(text):
    at, number = 0, 0
    for x in text.split("\n"):
        plain = " ".join(x.encode().lower().split(b" ") and [w.decode() for w in x.encode().lower().split()])
        if plain:
            yield plain, (at, at + len(x), number, len(plain.split(" ")))
            number += 1
        at += len(x) + 1


def test_units(make_docs, rows, hashes):
    later = list(repeats(rows, unit_entries, hashes))
    numbers = {}
    for i, text, e, _, _ in later:
        numbers.setdefault((i, text), {})[e[2]] = e[3]

    def run_words(i, text, number):
        of, total = numbers[i, text], 0
        low = number
        while low - 1 in of:
            low -= 1
        while low in of:
            total, low = total + of[low], low + 1
        return total

    want = sorted({str((i, e[2], e[0], e[1], k, ke[0])) for i, t, e, k, ke in later if run_words(i, t, e[2]) >= 30})
    got = units.repeated_units(make_docs(rows), min_words=30).drop("text_hash").collect()
    assert sorted(str(tuple(r)) for r in got) == want and len(want) > 50


def test_kept_spans(make_docs, rows):
    docs = make_docs(rows)
    got = units.without_repeated_units(docs, min_words=30)
    assert got.columns == [*docs.columns, "kept_spans"]
    texts = {}
    for i, t in rows:
        texts.setdefault(i, []).append(t)
    found = got.collect()
    assert len(found) == len(rows)
    changed = 0
    for r in found:
        if r.kept_spans is None:
            assert r.text is None
        else:
            assert any(t is not None and "".join(t[s.start:s.stop] for s in r.kept_spans) == r.text for t in texts[r.doc_id])
            changed += r.text not in texts[r.doc_id]
    assert changed > 10


def test_paragraphs(make_docs):
    long = " ".join(WORDS * 5)
    docs = make_docs([(2, f"{long}\nmore\n\n  \nother"), (1, f"start\n\n{long.upper()} \nmore")])
    got = units.repeated_units(docs, "paragraph").collect()
    assert [(r.doc_id, r.start, r.stop, r.kept_doc_id, r.kept_start) for r in got] == [(2, 0, len(long) + 5, 1, 7)]


def test_odd_and_empty(make_docs, odd_rows):
    for rows in ([], odd_rows):
        docs = make_docs(rows)
        assert line_chunks.without_repeated_chunks(docs).count() == len(rows)
        assert units.without_repeated_units(docs).count() == len(rows)
    removed = line_chunks.removed_chunks(make_docs(odd_rows)).collect()
    assert {(r.doc_id, r.kept_doc_id) for r in removed} == {(7, 6), (9, 6)}
    assert {(r.doc_id, r.kept_doc_id) for r in units.repeated_units(make_docs(odd_rows)).collect()} == {(7, 6), (9, 6)}


def slow_passages(docs, hashes):
    """Lines with words of all passages (two lines, eight words and more) that an earlier place has, by comparing every run of lines."""
    texts = sorted({(i is None, i or 0, hashes[t], t) for i, t in docs if t is not None})
    seen, gone = {}, {}
    for late, i, h, t in texts:
        lines = t.split("\n")
        for a in range(len(lines)):
            for b in range(a + 1, len(lines)):
                run = "\n".join(lines[a:b + 1])
                if len(run.split()) < 8 or not lines[a].strip() or not lines[b].strip():
                    continue
                kept = seen.setdefault(run, (h, i, late, b))
                if kept[:3] != (h, i, late) or a > kept[3]:
                    gone.setdefault((None if late else i, t), set()).update(k for k in range(a, b + 1) if lines[k].strip())
    return gone


def test_all_repeated_passages_are_found(make_docs, rows, hashes):
    want = {k: v for k, v in slow_passages(rows, hashes).items()}
    texts = {(i, hashes[t]): t for i, t in rows if t is not None}
    found = line_chunks._repeated_passages(make_docs(rows)).collect()
    got = {}
    for r in found:
        t = texts[r.doc_id, r.text_hash]
        got.setdefault((r.doc_id, t), set()).update(k for k in range(r.first, r.first + r.n) if t.split("\n")[k].strip())
    assert all(want[k] <= got.get(k, set()) for k in want) and set(got) - set(want) <= {k for k in got if "" in k[1].split("\n")}
    assert sum(map(len, want.values())) > 100


def test_planted_passages_go_whole(make_docs):
    """Passages of 2 to 10 lines, first and again between other neighbours: none of their lines stays."""
    rng, docs, planted = random.Random(12), [], {}

    def fresh(k):
        return [f"{line(rng)} n{rng.getrandbits(40)}" for _ in range(k)]

    for k in range(54):
        passage = fresh(2 + k % 9)
        planted[100 + k] = fresh(k % 4), passage, fresh(k % 3)
        docs += [(k, "\n".join(fresh(3) + passage + fresh(2))), (100 + k, "\n".join(sum(planted[100 + k], [])))]
    enough = {i for i, (_, p, _) in planted.items() if len(" ".join(p).split()) >= 8}
    got = {r.doc_id: r.text for r in line_chunks.without_repeated_passages(make_docs(docs)).collect()}
    for i, (before, _, after) in planted.items():
        if i in enough:
            assert got[i] == "\n".join(before + after)
    assert all(got[i] == t for i, t in docs if i < 100) and len(enough) > 45
    by_chunks = {r.doc_id: r.text for r in line_chunks.without_repeated_chunks(make_docs(docs)).collect()}
    assert sum(by_chunks[i] == got[i] for i in enough) < len(enough) // 2


def test_blank_lines_and_own_repeats(make_docs):
    a, b, c = ("one two three four five six", "seven eight nine", "ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen")
    docs = make_docs([(1, f"{a}\n\n\n{b}"), (2, f"x\n{a}\n\n\n{b}\ny"), (3, f"{c}\n"), (4, f"z\n{c}\n\nw"), (5, "\n".join(["u v w x y z"] * 5)), (6, f"{a}\n{b}"), (7, "\n" * 3000 + "end")])
    got = {r.doc_id: r.text for r in line_chunks.without_repeated_passages(docs).collect()}
    # A repeat never shares lines with its first occurrence, so two of five equal lines stay.
    assert got == {1: f"{a}\n\n\n{b}", 2: "x\ny", 3: f"{c}\n", 4: "z\nw", 5: "u v w x y z\nu v w x y z", 6: f"{a}\n{b}", 7: "\n" * 3000 + "end"}


def test_stage_cuts_short_passages(spark, make_docs):
    import corpus_pipeline

    rng = random.Random(6)
    docs = []
    for k in range(20):
        pair = [f"{line(rng)} p{k} and some more words here {m}" for m in range(2)]
        docs += [(k, "\n".join([f"a{k}", *pair, f"b{k}"])), (100 + k, "\n".join([f"c{k}", *pair, f"d{k}"]))]
    got = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, make_docs(docs), "").collect()}
    assert all(got[100 + k] == f"c{k}\nd{k}" for k in range(20))


def test_every_later_unit_and_bridged_runs(make_docs):
    long = [" ".join(f"w{k}_{m}" for m in range(30)) for k in range(2)]
    docs = make_docs([(1, "\n".join(["short line", *long])), (2, f"{long[0]}\nnew\n{long[1]}\nelse\nelse two\nSHORT  line")])
    got = {bridge: [(r.doc_id, r.unit, r.run_words) for r in units.later_units(docs, bridge=bridge).orderBy("unit").collect()] for bridge in (0, 1)}
    assert got == {0: [(2, 0, 30), (2, 2, 30), (2, 5, 2)], 1: [(2, 0, 60), (2, 2, 60), (2, 5, 2)]}
    assert {r.doc_id: r.text for r in units.without_repeated_units(docs, bridge=1).collect()}[2].split("\n") == ["", "new", "", "else", "else two", "SHORT  line"]


def test_sentences_copied_from_within_a_line(make_docs):
    """A passage that begins and ends inside lines; an own column called kept_spans stays."""
    passage = " ".join(f"{s} one two three four five six seven eight." for s in ("First", "Second", "Third", "Fourth"))
    docs = make_docs([(1, f"Before it all. {passage} And more follows\nEnd"), (2, f"Something else\nhere. {passage} Yet other words"), (3, "Second one two three four five six seven eight.")])
    docs = docs.withColumnRenamed("digest", "kept_spans")
    found = units.repeated_units(docs).collect()
    assert {(r.doc_id, r.kept_doc_id) for r in found} == {(2, 1)} and len(found) == 4
    got = units.without_repeated_units(docs)
    assert got.columns == [*docs.columns, "_kept_spans"]
    rows = {r.doc_id: r for r in got.collect()}
    assert rows[2].text.split() == "Something else here. Yet other words".split() and rows[2].kept_spans == "d"
    assert rows[1].text.count("three") == 4 and rows[3].text.startswith("Second")
