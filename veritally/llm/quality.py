"""Quality filtering by weak supervision, in DataFrame functions alone.

Each rule looks at one property of a text and votes good (1), bad (-1) or abstains (0). The rules'
accuracies are unknown; expectation-maximisation estimates them, and the share of good texts, from
how the votes agree over all documents that pass the hard base rules: given the accuracies a text is good with a posterior
probability, and given these a rule's accuracy on good and on bad texts is the expected share of
its votes there. A rule is accurate on one kind apart from the other, as defects are of many kinds:
few bad texts break a given rule, and hardly any good ones do. Votes take few values together, so documents are first counted by their votes (at most 3
to the number of rules groups), and the rounds run inside one expression over these counts. A
document is kept if it passes the hard base rules and its posterior reaches one half.

Words are runs of anything but 0x20 and 0x09-0x0D, over whole texts. Windows of three words are
compared by 64-bit hashes within one text. A null text counts as empty: no words, base_failed.
Null doc_ids and repeated rows get their row, an empty table gives an empty table, and other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import documents, staged

SPACE = r"[\x20\x09-\x0D]+"
INK = r"[^\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
ROUNDS = 30
#: What the estimates start from, and are drawn to by a share PULL of the documents: the share of good
#: texts, and how often a rule that votes calls a good and a bad text bad.
PRIOR, FALSE_ALARM, DETECTION = 0.8, 0.01, 0.3
PULL, LEAST = 0.05, 1e-4

#: Name, when a rule votes bad, and when good; SQL over the counts, in integers.
RULES = (
    ("symbols", "10 * n_symbols > n_words", "50 * n_symbols <= n_words"),
    ("letters", "5 * n_letters < 4 * word_chars", "100 * n_letters >= 92 * word_chars"),
    ("lines", "2 * n_dup_lines > n_lines", "n_dup_lines = 0"),
    ("repeats", "3 * n_repeat_words > n_words", "10 * n_repeat_words <= n_words"),
    ("word_length", "word_chars < 3 * n_words or word_chars > 10 * n_words", "2 * word_chars >= 7 * n_words and word_chars <= 8 * n_words"),
    ("capitals", "5 * n_capitals > word_chars", "12 * n_capitals <= word_chars"),
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, also where lambdas in it repeat."""
    return F.transform(F.array(value), body)[0]


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, b: a + b)


def repeated_words(words: Column) -> Column:
    """Words in three-word windows found twice or more."""

    def hashes(w: Column) -> Column:
        at = F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0)))
        return F.sort_array(F.transform(at, lambda x, i: F.struct(F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i"))))

    def twice(s: Column) -> Column:
        same = lambda x, other: F.coalesce(F.get(s, other)["h"] == x["h"], F.lit(False))
        return F.sort_array(F.transform(F.filter(s, lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"]))

    def covered(starts: Column) -> Column:
        rest = F.slice(starts, 2, F.size(starts))
        return _total(F.zip_with(starts, rest, lambda a, b: F.coalesce(F.least(b - a, F.lit(3)), F.lit(3)).cast("long")))

    return let(words, lambda w: let(hashes(w), lambda s: let(twice(s), covered)))


def counts(docs: DataFrame) -> DataFrame:
    """The counts of every whole text."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split("t", "\n", -1), lambda line: line.rlike(INK))
    return (
        documents(docs, "doc_id", "text")
        .select("doc_id", text.alias("t"))
        .select("doc_id", "t", F.filter(F.split("t", SPACE, -1), lambda w: w != "").alias("words"), lines.alias("lines"))
        .select(
            "doc_id",
            F.size("words").cast("long").alias("n_words"),
            F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
            (F.length("t") - F.length(F.regexp_replace("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
            (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
            repeated_words(F.col("words")).alias("n_repeat_words"),
            F.size("lines").cast("long").alias("n_lines"),
            (F.length("t") - F.length(F.regexp_replace("t", "[A-Z]", ""))).cast("long").alias("n_capitals"),
            (F.length("t") - F.length(F.regexp_replace("t", r"\p{L}", ""))).cast("long").alias("n_letters"),
        )
    )


def votes() -> list[Column]:
    return [F.expr(f"CASE WHEN {bad} THEN -1 WHEN {good} THEN 1 ELSE 0 END").alias(f"vote_{name}") for name, bad, good in RULES]


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, b: a + b)


def _vote_weights(alarm: Column, detection: Column) -> Column:
    """Per rule the log odds that a bad vote, no vote and a good vote add."""
    return F.zip_with(alarm, detection, lambda a, d: F.array(F.log(a / d), F.lit(0.0), F.log((1 - a) / (1 - d))))


def _estimate(patterns: Column) -> Column:
    """[share of good, false alarms of each rule, detections of each] from (votes, n)."""
    m = len(RULES)

    def round_(state: Column, _: Column) -> Column:
        def believe(weights: Column) -> Column:
            def belief(p: Column) -> Column:
                score = _sum(F.zip_with(p["votes"], weights, lambda v, w: F.get(w, v.cast("int") + 1))) + _logit(state[0])
                return F.struct(p["votes"].alias("votes"), p["n"].alias("n"), (1 / (1 + F.exp(-score))).alias("p"))

            return F.transform(patterns, belief)

        def update(seen: Column) -> Column:
            good, bad = (lambda x: x["n"] * x["p"]), (lambda x: x["n"] * (1 - x["p"]))
            n = _sum(F.transform(seen, lambda x: x["n"]))
            drawn = lambda part, whole, to: (part + PULL * to * n) / (whole + PULL * n)

            def called_bad(kind: Callable[[Column], Column], start: float) -> Column:
                def of(j: Column) -> Column:
                    among = lambda test: _sum(F.transform(seen, lambda x: F.when(test(F.get(x["votes"], j)), kind(x)).otherwise(0.0)))
                    return F.least(F.greatest(drawn(among(lambda v: v < 0), among(lambda v: v != 0), start), F.lit(LEAST)), F.lit(1 - LEAST))

                return F.transform(F.sequence(F.lit(0), F.lit(m - 1)), of)

            alarm = called_bad(good, FALSE_ALARM)
            detection = F.zip_with(called_bad(bad, DETECTION), alarm, lambda d, a: F.greatest(d, a))  # a bad vote never speaks for a text
            return F.concat(F.array(drawn(_sum(F.transform(seen, good)), n, PRIOR)), alarm, detection)

        return let(let(_vote_weights(F.slice(state, 2, m), F.slice(state, 2 + m, m)), believe), update)

    start = F.array(F.lit(PRIOR), *(F.lit(FALSE_ALARM) for _ in RULES), *(F.lit(DETECTION) for _ in RULES))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, round_)


def learn(voted: DataFrame) -> tuple[float, list[tuple[float, float, float]]]:
    """Log odds of good quality beforehand, and what a bad, no and a good vote of each rule add."""
    names, m = [f"vote_{name}" for name, _, _ in RULES], len(RULES)
    groups = voted.where("not base_failed").groupBy(*names).agg(F.count("*").cast("double").alias("n"))
    listed = groups.agg(F.sort_array(F.collect_list(F.struct(F.array(*(F.col(c).cast("double") for c in names)).alias("votes"), "n"))).alias("patterns"))
    state = listed.where(F.size("patterns") > 0).select(_estimate(F.col("patterns")).alias("state"))
    found = state.select(_logit(F.col("state")[0]).alias("prior"), _vote_weights(F.slice("state", 2, m), F.slice("state", 2 + m, m)).alias("weights")).first()
    return (found["prior"], [tuple(w) for w in found["weights"]]) if found else (0.0, [(0.0, 0.0, 0.0)] * m)


def judged(docs: DataFrame) -> DataFrame:
    """Counts, votes, posterior probability of good quality, and the verdict of every document.

    The counts are written once to the shared folder, as learning and judging both read them.
    """
    failed = F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words").alias("base_failed")
    voted = staged(counts(docs).select("*", failed, *votes()), "quality-counts")
    prior, weights = learn(voted)
    score = F.lit(prior)
    for (name, _, _), (bad, none, good) in zip(RULES, weights, strict=True):
        vote = F.col(f"vote_{name}")
        score = score + F.when(vote < 0, bad).when(vote > 0, good).otherwise(none)
    posterior = 1 / (1 + F.exp(-score))
    return voted.select("*", posterior.alias("quality_probability")).withColumn("kept", ~F.col("base_failed") & (F.col("quality_probability") >= 0.5))


def verdicts(docs: DataFrame) -> DataFrame:
    return judged(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def sql() -> str:
    """The same for DuckDB, with a table expression for each round."""
    names = [f"vote_{name}" for name, _, _ in RULES]
    ballots = ", ".join(f"CASE WHEN {bad} THEN -1 WHEN {good} THEN 1 ELSE 0 END AS vote_{name}" for name, bad, good in RULES)

    def belief(state: str) -> str:
        odds = "".join(
            f" + CASE WHEN {n} < 0 THEN ln({state}.a{j} / {state}.d{j}) WHEN {n} > 0 THEN ln((1 - {state}.a{j}) / (1 - {state}.d{j})) ELSE 0 END" for j, n in enumerate(names)
        )
        return f"1 / (1 + exp(-(ln({state}.share / (1 - {state}.share)){odds})))"

    def called_bad(n: str, q: str, start: float) -> str:
        among = lambda test: f"sum(CASE WHEN {n} {test} THEN {q} ELSE 0 END)"
        return f"least(greatest(({among('< 0')} + {PULL * start} * sum(n)) / ({among('<> 0')} + {PULL} * sum(n)), {LEAST}), {1 - LEAST})"

    start = "".join(f", CAST({FALSE_ALARM} AS DOUBLE) AS a{j}, CAST({DETECTION} AS DOUBLE) AS d{j}" for j in range(len(names)))
    rounds = [f"s0 AS (SELECT CAST({PRIOR} AS DOUBLE) AS share{start})"]
    for k in range(ROUNDS):
        new = "".join(f", {called_bad(n, 'n * p', FALSE_ALARM)} AS a{j}, {called_bad(n, 'n * (1 - p)', DETECTION)} AS e{j}" for j, n in enumerate(names))
        fixed = "".join(f", a{j}, greatest(e{j}, a{j}) AS d{j}" for j in range(len(names)))
        rounds.append(f"b{k} AS (SELECT pattern.*, {belief(f's{k}')} AS p FROM pattern, s{k})")
        rounds.append(f"m{k} AS (SELECT (sum(n * p) + {PULL * PRIOR} * sum(n)) / (sum(n) + {PULL} * sum(n)) AS share{new} FROM b{k})")
        rounds.append(f"s{k + 1} AS MATERIALIZED (SELECT share{fixed} FROM m{k})")
    return rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         [l FOR l IN string_split(coalesce(text, ''), chr(10)) IF regexp_matches(l, '[^\x20\x09-\x0D]')] AS l FROM documents),
g AS (
  SELECT doc_id, s, w[s:s + 2] AS words FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 1)::BIGINT)) AS s FROM d)),
r AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (
    SELECT g.doc_id, unnest(range(g.s, g.s + 3)) AS p FROM g JOIN (
      SELECT doc_id, words FROM g GROUP BY doc_id, words HAVING count(*) > 1) USING (doc_id, words)) GROUP BY doc_id),
c AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words,
         len(l)::BIGINT AS n_lines, (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')))::BIGINT AS n_capitals,
         (length(t) - length(regexp_replace(t, '\p{{L}}', '', 'g')))::BIGINT AS n_letters
  FROM d LEFT JOIN r USING (doc_id)),
v AS MATERIALIZED (SELECT *, {ballots}, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c),
pattern AS MATERIALIZED (SELECT {", ".join(names)}, count(*)::DOUBLE AS n FROM v WHERE NOT base_failed GROUP BY {", ".join(names)}),
{", ".join(rounds)}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND {belief(f"s{ROUNDS}")} >= 0.5 AS kept
FROM v, s{ROUNDS}
"""
