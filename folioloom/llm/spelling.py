"""Spelling variants: words that differ by one inserted, deleted or replaced code point, grouped under the most frequent form.

A word is seen as its bigrams, ordered from rare to common over all words. One edit spoils at most one of two disjoint bigrams. Each word has two such
pivots among its three rarest bigrams, those that occur least together (dynamic programming over positions), and its prefix: all bigrams up to
the third. Of two near words take the one whose prefix ends earlier in the order: a pivot of it that the edit spares lies in the other's
prefix. So pivots are joined with prefixes, on places and lengths that one edit can lead to, and what is found is verified.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioloom.llm.manifest import crc32_sql
from folioloom.operators.skew import fits_broadcast, stored

#: Code points from which on every word has a prefix of three bigrams, and so has its near word.
SHORTEST = 5
#: Rounds of following forms, each of which doubles the way; a form is at least `LEAD` times as frequent as its word.
MAX_ROUNDS = 8
LEAD = 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LETTERS = "[A-Za-zÀ-ÿ]"
#: How the length of the other word and the place of a spared bigram in it may differ.
_SHIFTS = ((0, 0), (1, 0), (1, 1), (-1, 0), (-1, -1))


def words_of(docs: DataFrame, least: int, change: Column | None = None) -> DataFrame:
    """`word` of every maximal run of letters with `least` code points and more in the whole texts, only A-Z lower-cased; NULL texts have none.

    `change` may be an expression over `doc_id` and `run` that gives the word in place of the run.
    """
    runs = docs.select(F.col("doc_id"), F.explode(F.regexp_extract_all("text", F.lit(f"{LETTERS}{{{least},}}"), F.lit(0))).alias("run"))
    runs = runs.withColumn("run", F.translate("run", UPPER, LOWER))
    return runs.select((F.col("run") if change is None else change).alias("word")).where(F.length("word") >= least)


def counted(words: DataFrame, least: int) -> DataFrame:
    """`word` and `n`, its occurrences, where these are `least` or more."""
    return words.where("word is not null").groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def _pivots(prefix: str) -> str:
    """The two disjoint bigrams of the prefix with the smallest sum of frequencies.

    One pass over places: `one` is the best bigram before the last, `last` the last one, `two` the best pair so far. All before the last are
    disjoint from the current bigram; the last is, unless it is its neighbour.
    """
    gram = "struct<f:bigint,pos:int,gram:string>"
    nothing = f"named_struct('one', cast(null as {gram}), 'last', cast(null as {gram}), 'two', cast(null as struct<f:bigint,a:{gram},b:{gram}>))"
    free = "least(s.one, if(s.last.pos < g.pos - 1, s.last, null))"
    pair = f"if({free} is null, null, struct({free}.f + g.f as f, {free} as a, g as b))"
    by_place = f"array_sort(transform({prefix}, g -> struct(g.f, g.pos, g.gram)), (x, y) -> x.pos - y.pos)"
    return f"aggregate({by_place}, {nothing}, (s, g) -> named_struct('one', least(s.one, s.last), 'last', g, 'two', least(s.two, {pair})), s -> array(s.two.a, s.two.b))"


def signatures(words: DataFrame) -> DataFrame:
    """`word`, `n`, `length`, `prefix` (bigrams with f, gram and pos, rare ones first) and `pivots` of stored words."""
    grams = words.select("word", "n", F.length("word").alias("length"), F.explode(F.sequence(F.lit(1), F.length("word") - 1)).alias("pos"))
    grams = grams.withColumn("gram", F.substring(F.col("word"), F.col("pos"), F.lit(2)))
    frequency = stored(grams.groupBy("gram").agg(F.count("*").alias("f")), "bigrams")
    known = grams.join(F.broadcast(frequency) if fits_broadcast(frequency) else frequency, "gram")
    ordered = known.groupBy("word", "n", "length").agg(F.array_sort(F.collect_list(F.struct("f", "gram", "pos"))).alias("all"))
    # Repeats of the third bigram belong to the prefix: the order knows bigrams, not places.
    ordered = ordered.withColumn("prefix", F.expr("filter(all, g -> g.f < all[2].f or g.f = all[2].f and g.gram <= all[2].gram)")).drop("all")
    return ordered.withColumn("pivots", F.expr(_pivots("prefix")))


def near_pairs(words: DataFrame) -> DataFrame:
    """`word`, `n`, `near`, `near_n` of all pairs of distinct words (`word`, `n`) one edit apart, in both directions. Words have SHORTEST code points at least."""
    marked = stored(signatures(words), "signatures")
    ends = [F.element_at("prefix", -1)[c].alias(f"last_{c}") for c in ("f", "gram")]
    shifts = F.expr(f"array({', '.join(f'struct({a} as by_length, {b} as by_place)' for a, b in _SHIFTS)})")
    left = marked.select("word", "n", "length", *ends, F.inline("pivots")).select("word", "n", "length", "last_f", "last_gram", "gram", "pos", F.inline(shifts))
    left = left.select("word", "n", "last_f", "last_gram", "gram", (F.col("pos") + F.col("by_place")).alias("pos"), (F.col("length") + F.col("by_length")).alias("length"))
    right = marked.select(F.col("word").alias("near"), F.col("n").alias("near_n"), "length", *ends, F.inline("prefix").alias("f", "gram", "pos"))
    right = right.select("near", "near_n", F.col("last_f").alias("end_f"), F.col("last_gram").alias("end_gram"), "gram", "pos", "length")
    before = (F.col("last_f") < F.col("end_f")) | ((F.col("last_f") == F.col("end_f")) & (F.col("last_gram") <= F.col("end_gram")))
    same = [left[c] == right[c] for c in ("gram", "pos", "length")]
    met = left.join(right, [*same, before, F.levenshtein("word", "near", 1) == 1]).select("word", "n", "near", "near_n").distinct()
    back = met.select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    return met.unionByName(back).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """`word` and `root`, where its `form` leads to, of words that have one. Forms never lead back."""
    way = stored(forms.select("word", F.col("form").alias("root")), "ways")
    for _ in range(MAX_ROUNDS):
        on = way.select(F.col("word").alias("root"), F.col("root").alias("further"))
        if way.join(on, "root", "left_semi").isEmpty():
            return way
        way = stored(way.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "ways")
    raise RuntimeError("forms did not end")


def spelling_groups(words: DataFrame, lead: int = LEAD) -> DataFrame:
    """`word`, `form`, `root`, `n`, `n_near`, `form_n` of distinct words (`word`, `n`).

    The form is the near word of largest n (ties: the smallest in code-point order) if that is `lead` times the word's own, else NULL; the root is where
    forms lead to, the word itself if it has none. Words have SHORTEST code points at least, else ValueError where they are read. An empty
    table gives no row.
    """
    if lead < 2:
        raise ValueError("lead is 2 or more")
    checked = F.when(F.length("word") >= SHORTEST, F.col("word")).otherwise(F.raise_error(F.lit(f"words have {SHORTEST} code points or more")).cast("string"))
    words = stored(words.select(checked.alias("word"), F.col("n").cast("long")), "words")
    near = near_pairs(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form"))).alias("best"))
    found = words.join(near, "word", "left").withColumn("form_n", -F.col("best.less"))
    ahead = F.col("form_n") >= lead * F.col("n")
    found = found.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(ahead, F.col("best.form")).alias("form"), F.when(ahead, F.col("form_n")).alias("form_n"))
    found = stored(found, "forms")
    ends = roots(found.where("form is not null"))
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of six letters that occur five times and more in `documents`, where one run of 199 has lost a letter, with their forms and roots."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), F.col("run")))
    at = (h % F.length("run")).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    return spelling_groups(counted(words_of(docs, 6, F.when(h % 199 == 0, cut).otherwise(F.col("run"))), 5))


SQL = f"""
with recursive runs as (select doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{LETTERS}{{6,}}')) run from documents),
k as (select doc_id, run, count(*) k from runs group by doc_id, run),
h as (select run, k, {crc32_sql("coalesce(doc_id::varchar, 'null') || ':' || run")} h from k),
c as (select case when h % 199 = 0 then substr(run, 1, (h % length(run))::bigint) || substr(run, (h % length(run))::bigint + 2) else run end word, k from h),
w as (select word, sum(k)::bigint n from c where length(word) >= 6 group by word having sum(k) >= 5),
x as (select word, n, unnest(range(1, length(word) + 1)) i from w),
s as (select word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) rest from x),
p as (select a.word, b.word near, b.n from s a join s b on a.i = b.i and a.rest = b.rest and length(a.word) = length(b.word) and a.word <> b.word
  union select a.word, b.word, b.n from s a join w b on a.rest = b.word union select b.word, a.word, a.n from s a join w b on a.rest = b.word),
q as (select word, count(*) n_near, max(n) best, arg_min(near, (-n, near)) form from (select distinct word, near, n from p) group by word),
f as (select w.word, w.n, coalesce(n_near, 0)::bigint n_near, case when best >= 5 * w.n then form end form, case when best >= 5 * w.n then best end form_n from w left join q using (word)),
t as (select word, word root from f union all select t.word, f.form from t join f on f.word = t.root where f.form is not null)
select f.word, f.form, r.root, f.n, f.n_near, f.form_n from f join (select word, root from t join (select word root from f where form is null) using (root)) r using (word)
"""
