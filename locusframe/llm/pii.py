"""Personal data by bootstrapped contextual extraction (operator 3; built-in functions only).

Base patterns give the seeds: e-mail and IP addresses, payment cards, phone numbers. Looser shapes (a number with separators or
plain, a card number whatever its check digit, a word with an @, a coloned address) give candidates of one kind; any other word
of five characters or more with a digit is a candidate of whatever kind its context says. Each occurrence has three lexical
patterns: the word before, the two words before, and the word after, past marks at the value itself. Patterns and instances (kind, value) form a bipartite graph
that Spark scores by turns: a pattern's confidence is the score it holds (its instances' scores, each as often as it occurs there)
over all places where the pattern's words stand in the corpus, damped when few seeds or accepted candidates support it; a
candidate's score is the noisy-or of its best pattern before and its pattern after, 0 without a confident one. Candidates that
end above the threshold are new spans, of those that overlap the best; base spans always stay. What is found in one round
supports patterns in the next.

Patterns whose instances, were all of them true, could not make them confident are dropped before the rounds (an exact bound):
common words go there, and with them most of the graph.

A document is scanned natively; only its occurrences, not its text, go into the graph. A second scan counts the places of the
patterns' words; these words are a written table, so Spark broadcasts them only where their size allows, and joins by shuffle beyond.
Groups are reduced by partial aggregates and joins on hot neighbouring words are left to AQE's skew split.

Positions: Spark returns matches without places, so a text is also split at them; piece and match lengths add up to places,
in code points. A fold over the matches goes by runs of RUN, so that what it has gathered is not copied at every match, and text is cut by blocks
of BLOCK code points, so that no cut counts from the start of a long text: the work is linear in the text. Which spans overlap is told by
running ends and starts in order of place, over the documents that hold spans to compare. Java's regular expressions are written with possessive loops, which need no stack, and with \\G and look-behind
so that a long run is entered at its start only.

Defined results: null text counts as empty (no spans); repeated rows give repeated results; null ids are kept; extra columns are
ignored; long texts are used whole; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from locusframe.llm.common import texts, written

KINDS = ("email", "ip", "card", "phone")
#: kind -> expression of the base, in Java's syntax.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: kind -> looser shape of a candidate.
SHAPES = {
    "email": r"(?:\G|(?<![^\x20\x09-\x0D]))[\p{L}0-9._%+-]++(?:@|\(at\)|\[at\])[\p{L}0-9.-]++",
    "ip": r"(?:\G|(?<![0-9A-Fa-f:]))[0-9A-Fa-f]{1,4}+(?::{1,2}[0-9A-Fa-f]{1,4}+){3,7}+",
    "card": r"(?<![0-9A-Za-z_.#=\"/-])[0-9](?:[\x20._/-]?[0-9]){11,18}+(?![0-9A-Za-z_])",
    "phone": r"(?:\G|(?<![0-9A-Za-z_.#=\"-]))(?:\(?[0-9]{2,5}+\)?(?:[\x20.-][0-9]{2,5}+){2,5}+|[0-9]{7,15}+)(?![0-9A-Za-z])",
}
#: A candidate of any kind: a word that holds a digit, without the marks behind it.
FREE = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9]*+[0-9](?:[^\x20\x09-\x0D]*[\p{L}0-9])?"
FREE_LENGTH = 5
#: What a text must hold for a pattern to match in it at all: cheap to test, and absent from most texts.
NEEDED = {
    ("email", True): "@", ("ip", True): r"[0-9]\.[0-9]", ("card", True): r"[0-9](?:[\x20-]?[0-9]){11}", ("phone", True): r"\+[0-9]",
    ("email", False): r"@|\(at\)|\[at\]", ("ip", False): r"[0-9A-Fa-f]:[0-9A-Fa-f:]", ("card", False): r"[0-9](?:[\x20._/-]?[0-9]){11}",
    ("phone", False): r"[0-9]{2}\)?[\x20.-][0-9]{2}|[0-9]{7}",
    ("free", False): "[0-9]",
}
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
SPACED, MARKS = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"
OTHER = r"[^\x20\x09-\x0D\p{L}0-9]"  # neither space, letter nor digit
RUN, BLOCK = 256, 4096
OCCURRENCE = "struct<kind:int,start:int,end:int,value:string,left:string,left2:string,right:string,seed:boolean>"


def luhn(digits: Column) -> Column:
    n = F.length(digits)
    at = lambda i: F.substring(digits, n - i + 1, F.lit(1)).cast("int")
    twice = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda s, i: s + F.when(i % 2 == 0, twice(at(i))).otherwise(at(i))) % 10 == 0


def valid(kind: str, v: Column) -> Column:
    digits = F.regexp_replace(v, "[^0-9]+", "")
    if kind == "ip":
        return v.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "card":
        return F.length(digits).between(12, 19) & F.when(F.length(digits).between(12, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def runs_of(items: Column) -> Column:
    """An array cut into runs of RUN items. items: a column, not an expression, which every run would work out anew."""
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / RUN).cast("int")), lambda k: F.slice(items, k * RUN + 1, F.lit(RUN)))
    return F.when(F.size(items) > 0, runs)


def gathered(runs: Column, step, kind: str) -> Column:
    """Fold over runs that gathers an array<kind>: step(state, item), state: (at, got), at from 0. One state a run: `at` carries on, `got` is the run's own."""
    state = f"struct<at:int,got:array<{kind}>>"
    begin = lambda done: F.struct(F.coalesce(F.try_element_at(done, F.lit(-1))["at"], F.lit(0)).alias("at"), F.array().cast(f"array<{kind}>").alias("got"))
    none = F.array().cast(f"array<{state}>")
    return F.coalesce(F.aggregate(runs, none, lambda acc, run: F.concat(acc, F.array(F.aggregate(run, begin(acc), step).cast(state)))), none)


def blocks_of(text: Column) -> Column:
    """The text in blocks of BLOCK code points, in one pass over it."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}+"), F.lit(0))


def cut(blocks: Column, start: Column, end: Column) -> Column:
    """Code points start to end (exclusive) of a text in blocks (a column, as in runs_of)."""
    i, j = F.floor(start / BLOCK).cast("int"), F.floor(end / BLOCK).cast("int")
    block = lambda k: F.coalesce(F.get(blocks, k), F.lit(""))
    head = F.substring(block(i), start - i * BLOCK + 1, F.lit(BLOCK))
    between = F.array_join(F.slice(blocks, i + 2, F.greatest(j - i - 1, F.lit(0))), "")
    parts = F.when(i == j, F.substring(block(i), start - i * BLOCK + 1, end - start)).otherwise(F.concat(head, between, F.substring(block(j), F.lit(1), end - j * BLOCK)))
    return F.when(end > start, parts).otherwise("")


def matches(text: Column, kind: str, pattern: str, seed: bool) -> Column:
    """Per match of a pattern the text before it, itself and the text after it, and last the text behind all; null where there can be none."""
    pieces, values = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.when(text.rlike(NEEDED[kind, seed]), F.arrays_zip(pieces.alias("p"), values.alias("v"), F.slice(pieces, 2, F.size(pieces)).alias("q")))


def occurrences(runs: Column, kind: str, seed: bool) -> Column:
    """array<OCCURRENCE> of the valid ones of matches(), in order."""
    loose = {"phone": lambda v: F.length(F.regexp_replace(v, "[^0-9]+", "")) >= 7, "free": lambda v: F.length(v) >= FREE_LENGTH}
    checked = (lambda v: valid(kind, v)) if seed else loose.get(kind, lambda v: F.lit(True))

    def step(acc, x):
        start = acc["at"] + F.length(x["p"])
        end = start + F.coalesce(F.length(x["v"]), F.lit(0))
        before = F.rtrim(F.translate(x["p"], "\t\n\x0b\x0c\r", "     "))
        before = F.rtrim(F.regexp_replace(before, rf"(?<!{MARKS}){OTHER}++$", ""))  # a bracket or quote before the value is no word
        left = F.substring_index(before, " ", -1)  # whole words, however long
        second = F.substring_index(F.rtrim(F.substring(before, F.lit(1), F.length(before) - F.length(left))), " ", -1)
        right = F.lower(F.regexp_extract(x["q"], rf"^{OTHER}*+{SPACED}*+({MARKS}++)", 1))
        one = F.struct(F.lit(KINDS.index(kind) if kind in KINDS else -1).alias("kind"), start.alias("start"), end.alias("end"), x["v"].alias("value"), F.lower(left).alias("left"),
                       F.when(second != "", F.lower(F.concat(second, F.lit(" "), left))).otherwise("").alias("left2"), F.coalesce(right, F.lit("")).alias("right"), F.lit(seed).alias("seed"))
        keep = x["v"].isNotNull() & checked(x["v"])
        return F.struct(end.alias("at"), F.when(keep, F.concat(acc["got"], F.array(one.cast(OCCURRENCE)))).otherwise(acc["got"]).alias("got"))

    return F.flatten(F.transform(gathered(runs, step, OCCURRENCE), lambda run: run["got"]))


def scanned(docs: DataFrame) -> DataFrame:
    """uid, doc_id, text_hash, base (seed occurrences by start and kind), shaped and free: candidates of a kind, and of any."""
    d = texts(docs).select(F.monotonically_increasing_id().alias("uid"), "doc_id", "text", F.xxhash64("text").alias("text_hash"))
    of = {**{f"b_{k}": (k, p, True) for k, p in BASE.items()}, **{f"s_{k}": (k, p, False) for k, p in SHAPES.items()}, "free": ("free", FREE, False)}
    for step in (lambda n, k, p, seed: matches(F.col("text"), k, p, seed), lambda n, k, p, seed: runs_of(F.col(n)), lambda n, k, p, seed: occurrences(F.col(n), k, seed)):
        d = d.select("uid", "doc_id", "text_hash", *(["text"] if "free" not in d.columns else []), *[step(n, *x).alias(n) for n, x in of.items()])
    by_place = lambda a: F.transform(F.array_sort(F.transform(a, lambda x: F.struct(x["start"].alias("a"), x["kind"].alias("b"), x["end"].alias("c"), x.alias("x")))), lambda y: y["x"])
    return d.select("uid", "doc_id", "text_hash", by_place(F.concat(*[f"b_{k}" for k in BASE])).alias("base"), F.concat(*[f"s_{k}" for k in SHAPES]).alias("shaped"), "free")


def apart(rows: DataFrame, holds: Column) -> DataFrame:
    """Rows (uid, start, end, ...) without those that overlap a row of `holds` in their document; rows of `holds` stay.

    By place, the furthest end of the holding rows that start no later, and the nearest start of those after.
    """
    w = Window.partitionBy("uid")  # both frames grow from the front: a frame that shrinks is worked out anew for every row
    reach = F.max(F.when(holds, F.col("end"))).over(w.orderBy("start").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    nearest = F.min(F.when(holds, F.col("start"))).over(w.orderBy(F.desc("start")).rangeBetween(Window.unboundedPreceding, -1))
    d = rows.withColumns({"_reach": reach, "_next": nearest, "_holds": holds})
    return d.where(F.col("_holds") | ~(F.coalesce(F.col("_reach") > F.col("start"), F.lit(False)) | F.coalesce(F.col("_next") < F.col("end"), F.lit(False)))).drop("_reach", "_next", "_holds")


def places(scan: DataFrame) -> DataFrame:
    """uid and the fields of OCCURRENCE: all base occurrences, the shaped ones apart from these, and the free ones apart from both."""
    level = lambda c, k: F.transform(c, lambda x: F.struct(F.lit(k).alias("level"), x.alias("o")))
    all_ = scan.select("uid", (F.size("base") + F.size("shaped") > 0).alias("compare"), F.inline(F.concat(level("base", 0), level("shaped", 1), level("free", 2))))
    all_ = all_.select("uid", "compare", "level", "o.*")
    near = apart(apart(all_.where("compare"), F.col("level") == 0), F.col("level") <= 1)
    return near.unionByName(all_.where("not compare")).drop("compare", "level")


def standing(docs: DataFrame, words: DataFrame) -> DataFrame:
    """(word, total): how often each of `words` (a word, or two with one space) stands in the corpus, in lower case."""
    w = F.split(F.lower(F.regexp_replace("text", rf"^{SPACED}++|{SPACED}++$", "")), rf"{SPACED}++")
    d = texts(docs).where(F.col("text").rlike(r"[^\x20\x09-\x0D]")).select(w.alias("w"))
    pairs = d.select(F.inline(F.arrays_zip(F.slice(F.concat(F.array(F.lit("")), "w"), 1, F.size("w")).alias("a"), F.col("w").alias("b"))))
    keys = pairs.select(F.explode(F.array("b", F.concat("a", F.lit(" "), "b"))).alias("word"))
    return keys.join(words, "word", "left_semi").groupBy("word").agg(F.count("*").alias("total"))


def scored_instances(occ: DataFrame, docs: DataFrame, rounds: int = 3, min_seeds: int = 3, confident: float = 0.5, accept: float = 0.9) -> DataFrame:
    """(kind, value, score) of candidate instances with a confident pattern. occ: kind (-1: any), value, left, left2, right, seed."""
    place, key = ["side", "word"], ["kind", "side", "word"]
    words = [F.struct(F.lit(side).alias("side"), F.col(c).alias("word")) for side, c in (("l", "left"), ("ll", "left2"), ("r", "right"))]
    sides = occ.select("kind", "value", "seed", F.inline(F.array(*words))).where("word <> ''")
    found = written(sides.groupBy("kind", "value", *place).agg(F.max("seed").alias("seed"), F.count("*").alias("n")), "pii-found")
    # Patterns of too few instances can never be confident, nor can those that no candidate has find anything.
    near = written(found.groupBy(*place).agg(F.count("*").alias("held"), F.count_if("seed").alias("seeds"), F.sum("n").alias("n")).where(f"held >= {min_seeds} and held > seeds"), "pii-near")
    total = standing(docs, written(near.select("word").distinct(), "pii-words"))
    able = near.join(total, "word", "left").select(*place, "n", F.greatest("n", F.coalesce("total", "n")).alias("total")).where(F.col("n") >= F.col("total") * confident).drop("n")
    edges = written(found.join(able, place), "pii-able")
    # A word without a shape takes the kinds of the patterns it stands in, at first hand or through what these find.
    shaped, free = edges.where("kind >= 0"), edges.where("kind < 0").drop("kind")
    full = shaped
    for _ in range(2):
        kinds = free.join(full.groupBy(*key).count().where(f"count >= {min_seeds}").select(*key), place).select("value", "kind").distinct()
        full = shaped.unionByName(free.join(kinds, "value"))
    edges = written(full.groupBy("value", *key).agg(F.max("seed").alias("seed"), F.sum("n").alias("n"), F.max("total").alias("total")), "pii-edges")
    score = edges.groupBy("kind", "value").agg(F.max("seed").alias("seed")).where("seed").select("kind", "value", "seed", F.lit(1.0).alias("score"))
    for _ in range(rounds):
        # Of all places of a pattern those that hold no instance, or one without a score, count 0.
        held = edges.drop("seed").join(score.select("kind", "value", "score"), ["kind", "value"])
        conf = held.groupBy(*key).agg((F.sum(F.col("n") * F.col("score")) / F.max("total")).alias("share"), F.count_if(F.col("score") >= accept).alias("support")).where(f"support >= {min_seeds}")
        conf = conf.select(*key, (F.col("share") * (1 - F.pow(F.lit(0.5), F.col("support").cast("double")))).alias("conf")).where(F.col("conf") >= confident)
        best = lambda after: F.coalesce(F.max(F.when((F.col("side") == "r") == after, F.col("conf"))), F.lit(0.0))
        new = edges.join(conf, key, "left").groupBy("kind", "value").agg(F.max("seed").alias("seed"), (1 - (1 - best(False)) * (1 - best(True))).alias("p"))
        score = written(new.select("kind", "value", "seed", F.when(F.col("seed"), 1.0).otherwise(F.col("p")).alias("score")).where("score > 0"), "pii-scores")
    return score.where("not seed").select("kind", "value", "score")


def find_pii(docs: DataFrame, accept: float = 0.9, rounds: int = 3) -> DataFrame:
    """doc_id, text_hash, base and spans: arrays of OCCURRENCE; spans holds the base and what the graph adds, by start and kind."""
    d = written(scanned(docs), "pii-scan")
    both = written(places(d), "pii-places")
    good = scored_instances(both, docs, rounds, accept=accept).where(F.col("score") >= accept).select(F.col("kind").alias("as_kind"), "value", "score")
    fields = ["start", "kind", "end", "value", "left", "left2", "right", "seed"]
    one = F.struct(*[F.col("as_kind").alias(c) if c == "kind" else F.col(c) for c in fields])
    new = both.where("not seed").join(good, "value").where("kind in (-1, as_kind)").select("uid", "score", one.alias("o")).distinct()
    new = best_apart(new).groupBy("uid").agg(F.array_sort(F.collect_list("o")).alias("new"))
    by_start = F.transform("base", lambda x: F.struct(*[x[c].alias(c) for c in fields]))
    merged = F.array_sort(F.concat(by_start, F.coalesce("new", F.array().cast("array<struct<start:int,kind:int,end:int,value:string,left:string,left2:string,right:string,seed:boolean>>"))))
    return d.join(new, "uid", "left").select("doc_id", "text_hash", "base", merged.alias("spans"))


def best_apart(new: DataFrame, width: int = 32) -> DataFrame:
    """Of overlapping candidates (a number may be a card or a phone) the better score stays, then the longer, the first and the lesser kind.

    new: uid, score, o. Spans meet only those that touch the same stretch of `width` code points of their document.
    """
    rank = F.struct((-F.col("score")).alias("a"), (F.col("o.start") - F.col("o.end")).alias("b"), F.col("o.start").alias("c"), F.col("o.kind").alias("d"))
    x = new.select("uid", "o", rank.alias("rank"), F.explode(F.sequence(F.floor(F.col("o.start") / width), F.floor((F.col("o.end") - 1) / width))).alias("at"))
    y = x.select("uid", "at", F.col("rank").alias("other"), F.col("o.start").alias("lo"), F.col("o.end").alias("hi"))
    beaten = x.join(y, ["uid", "at"]).where("lo < o.end and o.start < hi and other < rank").select("uid", "o").distinct()
    return new.join(beaten, ["uid", "o"], "left_anti")


def shown(spans: Column) -> Column:
    name = lambda k: F.element_at(F.array(*map(F.lit, KINDS)), k + 1)
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", name(x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def with_masked(df: DataFrame, text: str, spans: str, name: str) -> DataFrame:
    """df with `name`: the text with every span replaced by its kind in brackets; overlapping spans are replaced once. Without spans, the text."""
    label = lambda k: F.concat(F.lit("["), F.element_at(F.array(*map(F.lit, KINDS)), k + 1), F.lit("]"))
    hit = F.size(spans) > 0

    def step(acc, x):
        piece = F.concat(cut(F.col("_blocks"), acc["at"], F.greatest(x["start"], acc["at"])), label(x["kind"]))
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.when(x["start"] >= acc["at"], F.concat(acc["got"], F.array(piece))).otherwise(acc["got"]).alias("got"))

    d = df.withColumns({"_blocks": F.when(hit, blocks_of(F.col(text))), "_runs": F.when(hit, runs_of(F.col(spans)))})
    d = d.withColumn("_parts", F.when(hit, gathered(F.col("_runs"), step, "string")))
    end = F.coalesce(F.try_element_at("_parts", F.lit(-1))["at"], F.lit(0))
    done = F.concat(F.array_join(F.flatten(F.transform("_parts", lambda r: r["got"])), ""), cut(F.col("_blocks"), end, F.length(text)))
    return d.withColumn(name, F.when(hit, done).otherwise(F.col(text))).drop("_blocks", "_runs", "_parts")


def op3_personal_data(docs: DataFrame) -> DataFrame:
    d = find_pii(docs)
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == KINDS.index(k))).cast("bigint").alias(f"n_{k}")
    return d.select("doc_id", *[count(k) for k in KINDS], F.sha2(shown(F.col("base")).cast("binary"), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"))
