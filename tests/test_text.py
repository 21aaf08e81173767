"""Content expressions against slow Python models."""

import random

import pytest
from pyspark.sql import functions as F

from folioloom.config import Processing, Rendering
from folioloom.functions import text as T
from folioloom.operators.content import process_content, python_filter
from folioloom.operators.render import block, summary_line

WHITE = set(T.WHITESPACE_CHARS)


def split_lines(text):
    out = text.split("\n")
    if out[-1] == "":
        out.pop()
        ends = [True] * len(out)
    else:
        ends = [True] * (len(out) - 1) + [False]
    return [line[:-1] if end and line.endswith("\r") else line for line, end in zip(out, ends)]


def strip_white(line, left=True):
    while line and line[-1] in WHITE:
        line = line[:-1]
    while left and line and line[0] in WHITE:
        line = line[1:]
    return line


def model_counts(text):
    words, inside = 0, False
    for c in text:
        if c in WHITE:
            inside = False
        elif not inside:
            inside, words = True, words + 1
    return len(split_lines(text)), len(text.encode()), words


def model_comments(text):
    """Position-based reading: at each position decide what starts there."""
    kept, at = [], 0
    while at < len(text):
        two = text[at:at + 2]
        if two == "//":
            end = text.find("\n", at)
            at = len(text) if end < 0 else end
        elif two == "/*":
            end = text.find("*/", at + 2)
            at = len(text) if end < 0 else end + 2
        elif text[at] in "\"'":
            quote, end = text[at], at + 1
            while end < len(text) and text[end] != quote:
                end += 2 if text[end] == "\\" else 1
            end = min(end + 1, len(text))
            kept.append(text[at:end])
            at = end
        else:
            kept.append(text[at])
            at += 1
    return "\n".join(strip_white(line, left=False) for line in split_lines("".join(kept))).strip("\r\n")


def model_empty_lines(text):
    return "\n".join(line for line in split_lines(text) if strip_white(line))


def model_numbered(text):
    rows = split_lines(text)
    width = max(5, len(str(len(rows))))
    return "".join(f"{i:>{width}} | {line}\n" for i, line in enumerate(rows, 1))


ALPHABET = ["a", "b ", " ", "\t", "\n", "\n", "\r\n", "\r", "/", "//", "/*", "*/", "*", '"', "'", "\\", "　", "\xa0", "é", "\x85"]


@pytest.fixture(scope="module")
def samples(spark):
    rng = random.Random(7)
    texts = ["", "\n", "\r\n", " ", "/", "//", "/*", "/*/", '"', "'", "a /** b **/ c", 'x = "// \\" /*"; // end\n',
             "it's // hidden by the apostrophe\n", "a\n\n \t\nb", "a / / b", "'\\'' // c", '"\\', "'\\\\' /* x"]
    texts += ["".join(rng.choices(ALPHABET, k=rng.randrange(1, 40))) for _ in range(3000)]
    return texts, spark.createDataFrame(list(enumerate(texts)), "id int, t string").repartition(4).cache()


def check(samples, expression, model):
    texts, frame = samples
    got = {r.id: r.x for r in frame.select("id", expression(F.col("t")).alias("x")).collect()}
    wrong = [(texts[i], got[i], model(texts[i])) for i in got if got[i] != model(texts[i])]
    assert not wrong, wrong[:3]


def test_counts(samples):
    check(samples, lambda t: T.counts(t), model_counts)


def test_remove_comments(samples):
    check(samples, T.remove_comments, model_comments)


def test_remove_empty_lines(samples):
    check(samples, T.remove_empty_lines, model_empty_lines)


def test_lines_and_numbers(samples):
    check(samples, T.lines, split_lines)
    check(samples, T.numbered, model_numbered)
    check(samples, T.terminated, lambda t: "".join(line + "\n" for line in split_lines(t)))


def test_number_width_grows(spark):
    text = "x\n" * 100_000
    row = spark.createDataFrame([(text,)], "t string").select(T.numbered(F.col("t")).alias("x")).first().x
    assert row == model_numbered(text)


def test_long_literals_and_comments(spark):
    texts = ['"' + "\\n" * 100_000 + '" // c', "/*" + "x" * 2_000_000, "'" + "y" * 2_000_000, "a" + " " * 300_000 + "b  \n"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(T.remove_comments(F.col("t")).alias("x")).collect()
    assert [r.x for r in got] == [model_comments(t) for t in texts]


BYTES = [
    (b"plain", True, True), (b"", True, True), (b"\xef\xbb\xbfhi", True, True), (b"\xef\xbb\xbf\xff", True, True),
    (b"a\x00b", False, False), (b"x" * 2000 + b"\x00", True, True), (b"x" * 1023 + b"\x00", False, False),
    (b"%PDF-1.4", False, False), (b"Hell\x80o", False, False), (b"\x89PNG\r\n\x1a\n", False, False),
    (b"x" * 1023 + "é".encode(), True, False), (b"x" * 1500 + b"\xff", False, True),
]


def test_text_detection(spark):
    rows = spark.createDataFrame([(i, bytearray(b)) for i, (b, _, _) in enumerate(BYTES)], "id int, content binary")
    got = rows.select("id", T.is_text(F.col("content")).alias("whole"), T.is_text_head(F.col("content")).alias("head"))
    assert {r.id: (r.whole, r.head) for r in got.collect()} == {i: (w, h) for i, (_, w, h) in enumerate(BYTES)}


def test_lossy_decoding(spark):
    data = [b"a\xffb", b"\xe2\x82", b"\xf0\x9f\x98\x80", b"\xef\xbb\xbfx\xc3", b"\xed\xa0\x80"]
    rows = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(data)], "id int, content binary")
    got = {r.id: r.x for r in rows.select("id", T.decode(F.col("content")).alias("x")).collect()}
    assert got == {i: b.decode("utf-8", "replace") for i, b in enumerate(data)}


def corpus(spark, files):
    return spark.createDataFrame([(p, p, bytearray(c), len(c)) for p, c in files.items()],
                                 "relative_path string, absolute_path string, content binary, size bigint")


def test_processing(spark):
    files = {"a.rs": b"// top\n\nfn main() {}\n", "b.txt": b"Hello", "c.bin": b"bin\x00 // ary\n\n"}
    text_only = process_content(corpus(spark, files), Processing(counts=True, remove_comments=True, remove_empty_lines=True))
    got = {r.relative_path: (r.processed_content, tuple(r.counts), r.is_binary) for r in text_only.collect()}
    assert got == {"a.rs": ("fn main() {}", (3, 21, 5), False), "b.txt": ("Hello", (1, 5, 1), False)}
    everything = process_content(corpus(spark, files), Processing(include_binary=True, counts=True, remove_comments=True))
    binary = everything.where("is_binary").first()
    assert (binary.relative_path, binary.processed_content, tuple(binary.counts)) == ("c.bin", "bin\x00 // ary\n\n", (0, 13, 0))
    assert process_content(corpus(spark, files), Processing()).where("counts is not null").count() == 0


def test_own_filters_run_first(spark):
    own = python_filter(lambda t: t.replace("KEEP", "// gone"), "own")
    assert own.__name__ == "own"
    rows = process_content(corpus(spark, {"a.c": b"x KEEP\ny"}), Processing(filters=[own], remove_comments=True))
    assert rows.first().processed_content == "x\ny"


BLOCKS = [
    ("src/main.rs", "fn main() {\n}", Rendering(), "## File: src/main.rs\n```rs\nfn main() {\n}\n```\n"),
    ("Makefile", "all:", Rendering(ticks=4), "## File: Makefile\n````\nall:\n````\n"),
    (".env", "", Rendering(line_numbers=True), "## File: .env\n```\n```\n"),
    ("a/.env.local", "\n", Rendering(), "## File: a/.env.local\n```local\n\n```\n"),
    ("a/b.js", "x\r\ny\n", Rendering(True, True, True), "## File: `b.js`\n```js\n    1 | x\n    2 | y\n```\n"),
    ("gone.txt", None, Rendering(), "## File: gone.txt\n```txt\n// Content not available\n```\n"),
    ("dir\\w.", "z", Rendering(), "## File: dir/w.\n```\nz\n```\n"),
]


@pytest.mark.parametrize("path, content, style, expected", BLOCKS)
def test_blocks(spark, path, content, style, expected):
    row = spark.createDataFrame([(path, content)], "p string, c string").select(block(F.col("p"), F.col("c"), style).alias("x"))
    assert row.first().x == expected


def test_summary_lines(spark):
    rows = spark.createDataFrame([("a.rs", (1, 2, 3), False), ("b.bin", (0, 9, 0), True), ("c", None, False)],
                                 "p string, counts struct<lines:bigint,characters:bigint,words:bigint>, b boolean")

    def rendered(style):
        return [r.x for r in rows.select(summary_line(F.col("p"), F.col("counts"), F.col("b"), style).alias("x")).collect()]

    assert rendered(Rendering(summary=True)) == ["- a.rs", "- b.bin", "- c"]
    assert rendered(Rendering(counts=True, backticks=True)) == [
        "- `a.rs` (L:1 C:2 W:3)", "- `b.bin` (Binary C:9)", "- `c` (Counts not available)"]
