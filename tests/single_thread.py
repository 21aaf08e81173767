"""

    python tests/single_thread.py SF_DIR [TIMES]

TIMES repeats the texts, each copy in a folder of its own. Input is in memory before the clock starts, on the Spark side as a cached table.
"""

import os
import re
import sys
import tempfile
import time

import duckdb

sys.path[:0] = [os.path.dirname(os.path.dirname(os.path.abspath(__file__)))]

from folioloom.functions.patterns import compile_ignore_line  # noqa: E402
from folioloom.plans import catalog, corpora  # noqa: E402

COMMENT = re.compile(r'("(?:[^"\\]|\\.)*(?:"|\\?\Z)|\'(?:[^\'\\]|\\.)*(?:\'|\\?\Z))|//[^\n]*|/\*.*?(?:\*/|\Z)', re.S)


def clean(text):
    text = COMMENT.sub(lambda m: m[1] or "", text)
    return "\n".join(line for line in (line.rstrip() for line in text.split("\n")) if line).strip()


def ignored(path, rules):
    parts = path.split("/")
    for n in range(1, len(parts) + 1):
        node = "/".join(parts[:n])
        for base, line, regex in rules:
            inside = node if not base else node[len(base) + 1:] if node.startswith(base + "/") else None
            if inside and (n < len(parts) or not line.dir_only) and regex.search(inside):
                if not line.negated:
                    return True
                break
    return False


def block(path, text):
    return f"## File: {path}\n```{path.rpartition('.')[2]}\n{text}{'' if not text or text.endswith(chr(10)) else chr(10)}```\n"


def plain(files):
    wanted = {"rs", "md", "txt"}
    rules = [(b, line, re.compile(line.regex.replace(r"\z", r"\Z"))) for _, b, _, p in reversed(catalog.RULES) if (line := compile_ignore_line(p))]
    yield "selection", lambda: [p for p, t in files if p.rpartition(".")[2].lower() in wanted and len(t.encode()) <= 4096 and re.search("src1", p, re.I) and ".git" not in p.split("/")]
    yield "counts", lambda: [(t.count("\n") + (t != "" and not t.endswith("\n")), len(t.encode()), len(t.split())) for _, t in files]
    yield "comments and empty lines", lambda: [clean(t) for _, t in files]
    yield "blocks", lambda: [block(p, t) for p, t in files]
    yield "ignore rules", lambda: [p for p, _ in files if not ignored(p, rules)]

    def sink():
        with tempfile.TemporaryFile("w", encoding="utf-8") as out:
            for k, (p, t) in enumerate(sorted(files, key=lambda f: f[0].split("/"))):
                out.write("\n" * bool(k) + block(p, t))

    yield "ordered document", sink


def on_spark(spark, files):
    from pyspark.sql import functions as F

    from folioloom import Digest, Processing, Rendering, Selection
    from folioloom.operators import ignore, render
    from folioloom.operators.content import process_content
    from folioloom.operators.select import select_files
    from folioloom.sources import corpus_from_table

    table = spark.createDataFrame(files, "path string, text string").repartition(8).cache()
    table.count()
    corpus = corpus_from_table(table, "path", "text")

    def run(rows):
        rows.write.format("noop").mode("overwrite").save()

    yield "selection", lambda: run(select_files(corpus, Selection(extensions=["rs", "md", "txt"], max_size=4096, path_regex=["src1"])))
    yield "counts", lambda: run(process_content(corpus, Processing(counts=True)).select("counts"))
    yield "comments and empty lines", lambda: run(process_content(corpus, Processing(remove_comments=True, remove_empty_lines=True)).select("processed_content"))
    yield "blocks", lambda: run(render.with_blocks(process_content(corpus, Processing()), Rendering()).select("block"))
    yield "ignore rules", lambda: run(ignore.drop_ignored(corpus, catalog.RULES))
    folder = tempfile.mkdtemp()
    yield "ordered document", lambda: Digest(Selection(path_regex=[r"\.git/", "."])).write(corpus.select("*", F.lit(False).alias("is_process_last")), f"{folder}/document")


def main():
    folder, times = sys.argv[1], int(sys.argv[2]) if len(sys.argv) > 2 else 1
    sql = f"select {corpora.PATH}, {corpora.CODE} from read_parquet('{folder}/documents.parquet')"
    once = duckdb.sql(sql).fetchall()
    files = [(f"copy{k}/{p}" if times > 1 else p, t) for k in range(times) for p, t in once]
    print(f"{len(files)} files, {sum(len(t.encode()) for _, t in files) / 1e6:.0f} MB", flush=True)
    seconds = {}
    for name, work in plain(files):
        began = time.perf_counter()
        work()
        seconds[name] = time.perf_counter() - began
    from pyspark.sql import SparkSession

    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.driver.memory", "12g")
             .config("spark.ui.showConsoleProgress", "false").config("spark.rpc.message.maxSize", "1024").config("spark.driver.maxResultSize", "0").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    for name, work in on_spark(spark, files):
        work()
        began = time.perf_counter()
        work()
        print(f"| {name} | {seconds[name]:.2f} | {time.perf_counter() - began:.2f} |", flush=True)


if __name__ == "__main__":
    main()
