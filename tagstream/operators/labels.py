"""Label tables: last-wins history, merging with precedence, balance, splits and top-up plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.dialect import adapter, frame, relational
from ..plans.shared import numbered

EXCLUDED, LEAST_SCORE, SEED, FOLDS, VAL = "0", 0.75, 42, 5, 0.15
SCOPE = "('0', '1', '2', '3', '4', '5', '6', '7', '8')"


def last_wins(log: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return log.withColumn("rn_", F.row_number().over(w)).where("rn_ = 1").drop("rn_")


def accepted(preds: DataFrame, least: float = LEAST_SCORE, excluded: str = EXCLUDED) -> DataFrame:
    """One ASCII digit, not excluded, score high enough."""
    return preds.where(F.col("pred_text").rlike("^[0-9]$") & (F.col("pred_text") != excluded) & (F.col("score") >= least))


def merged(manual: DataFrame, auto: DataFrame) -> DataFrame:
    """crop_id, digit, source: the last non-empty manual label wins over the last accepted automatic one."""
    m = last_wins(manual.where("digit <> ''"), "crop_id", "log_pos").select("crop_id", F.col("digit").alias("m"))
    a = last_wins(accepted(auto), "crop_id", "pos").select("crop_id", F.col("pred_text").alias("a"))
    both = m.join(a, "crop_id", "full_outer")
    return both.select("crop_id", F.coalesce("m", "a").alias("digit"), F.when(F.col("m").isNotNull(), "manual").otherwise("auto").alias("source"))


def labels(spark, sf_dir) -> DataFrame:
    return merged(adapter(spark, sf_dir, "manual_log"), adapter(spark, sf_dir, "auto_preds"))


def m_sql(d):
    return "SELECT crop_id, digit FROM (SELECT *, row_number() OVER (PARTITION BY crop_id ORDER BY log_pos DESC) AS rn FROM manual_log WHERE digit <> '') t WHERE rn = 1"


def a_sql(d):
    return f"SELECT crop_id, pred_text AS digit FROM (SELECT *, row_number() OVER (PARTITION BY crop_id ORDER BY pos DESC) AS rn FROM auto_preds WHERE {d.match('pred_text', '[0-9]')} AND pred_text <> '0' AND score >= 0.75) t WHERE rn = 1"


def l_sql(d):
    return "SELECT coalesce(m.crop_id, a.crop_id) AS crop_id, coalesce(m.digit, a.digit) AS digit, CASE WHEN m.digit IS NOT NULL THEN 'manual' ELSE 'auto' END AS source FROM m FULL OUTER JOIN a ON m.crop_id = a.crop_id"


LABELS = {"m": m_sql, "a": a_sql, "labels": l_sql}
MA = ("manual_log", "auto_preds")


@frame("digit_balance", "SELECT CAST(g AS VARCHAR) AS digit, count(l.digit) AS n FROM generate_series(0, 9) t(g) LEFT JOIN labels l ON l.digit = CAST(g AS VARCHAR) GROUP BY g", MA, {**LABELS, "labels": lambda d: l_sql(d)} | {})
def digit_balance(spark, sf_dir):
    """Dense counts over the digits 0 to 9."""
    domain = spark.range(10).select(F.col("id").cast("string").alias("digit"))
    counts = labels(spark, sf_dir).groupBy("digit").agg(F.count("*").alias("n"))
    return domain.join(F.broadcast(counts), "digit", "left").select("digit", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@frame("last_wins", "SELECT crop_id, digit FROM m", ("manual_log",), {"m": m_sql})
def last_wins_query(spark, sf_dir):
    return last_wins(adapter(spark, sf_dir, "manual_log").where("digit <> ''"), "crop_id", "log_pos").select("crop_id", "digit")


@frame("label_merge", "SELECT crop_id, digit, source FROM labels", MA, LABELS)
def label_merge(spark, sf_dir):
    return labels(spark, sf_dir)


@frame("auto_accept", "SELECT count(*) AS total, count(*) FILTER (WHERE regexp_full_match(pred_text, '[0-9]') AND pred_text <> '0' AND score >= 0.75) AS accepted FROM auto_preds", ("auto_preds",))
def auto_accept(spark, sf_dir):
    p = adapter(spark, sf_dir, "auto_preds")
    ok = F.col("pred_text").rlike("^[0-9]$") & (F.col("pred_text") != EXCLUDED) & (F.col("score") >= LEAST_SCORE)
    return p.agg(F.count("*").alias("total"), F.count_if(ok).alias("accepted"))


@relational("ocr_normalize", "auto_preds")
def ocr_normalize(d):
    x = "upper(trim(pred_text))"
    return f"SELECT pos, CASE WHEN {x} = 'O' THEN '0' WHEN {d.match(x, '[0-9]')} THEN {x} END AS digit FROM auto_preds"


@relational("label_conflicts", *MA)
def label_conflicts(d):
    """Labels that differ from the one before, by source, in the order in which the sources are merged."""
    return f"""SELECT count(CASE WHEN before <> digit AND src = before_src THEN 1 END) AS within_source, count(CASE WHEN before <> digit AND src <> before_src THEN 1 END) AS between_sources
      FROM (SELECT digit, src, lag(digit) OVER w AS before, lag(src) OVER w AS before_src FROM (
        SELECT crop_id, digit, 1 AS src, log_pos AS pos FROM manual_log WHERE digit <> ''
        UNION ALL SELECT crop_id, pred_text, 0, pos FROM auto_preds WHERE {d.match('pred_text', '[0-9]')} AND pred_text <> '0' AND score >= 0.75) u
        WINDOW w AS (PARTITION BY crop_id ORDER BY src, pos)) t"""


@frame("label_todo", "SELECT crop_id FROM crops WHERE crop_id NOT IN (SELECT crop_id FROM manual_log UNION SELECT crop_id FROM auto_preds WHERE regexp_full_match(pred_text, '[0-9]') AND pred_text <> '0' AND score >= 0.75)", ("crops", *MA))
def label_todo(spark, sf_dir):
    """Crops without any label; unreadable ones count as labelled."""
    done = adapter(spark, sf_dir, "manual_log").select("crop_id").unionByName(accepted(adapter(spark, sf_dir, "auto_preds")).select("crop_id")).distinct()
    return adapter(spark, sf_dir, "crops").select("crop_id").join(done, "crop_id", "left_anti")


@frame("priority_queue", "SELECT c.crop_id, c.video, c.frame, p.pred_text AS digit, round(p.score, 4) AS score, row_number() OVER (ORDER BY p.score DESC, p.pos) AS place FROM auto_preds p JOIN crops c ON c.crop_id = p.crop_id WHERE p.pred_text IN ('0', '5', '7') AND p.crop_id NOT IN (SELECT crop_id FROM manual_log)", ("crops", *MA))
def priority_queue(spark, sf_dir):
    p = adapter(spark, sf_dir, "auto_preds").where(F.col("pred_text").isin("0", "5", "7")).join(adapter(spark, sf_dir, "manual_log").select("crop_id").distinct(), "crop_id", "left_anti")
    c = adapter(spark, sf_dir, "crops").select("crop_id", "video", "frame")
    return numbered(p.join(c, "crop_id"), "place", F.desc("score"), "pos").select("crop_id", "video", "frame", F.col("pred_text").alias("digit"), F.round("score", 4).alias("score"), "place")


VALIDITY = """SELECT crop_id, digit, coalesce(bool_or(manual) OVER (PARTITION BY owner), false) AS valid FROM (
  SELECT crop_id AS owner, crop_id, digit, source = 'manual' AS manual FROM labels UNION ALL SELECT source_crop_id, crop_id, digit, false FROM synthetic) u"""


@frame("left_validity", VALIDITY, (*MA, "synthetic"), LABELS)
def left_validity(spark, sf_dir):
    """Real and synthetic labels; a synthetic one is valid if its source has a manual label."""
    real = labels(spark, sf_dir)
    known = real.where("source = 'manual'").select(F.col("crop_id").alias("source_crop_id"), F.lit(True).alias("v"))
    s = adapter(spark, sf_dir, "synthetic").join(known, "source_crop_id", "left").select("crop_id", "digit", F.coalesce("v", F.lit(False)).alias("valid"))
    return s.unionByName(real.select("crop_id", "digit", (F.col("source") == "manual").alias("valid")))


def counts_sql(d):
    return f"SELECT digit, count(*) AS n FROM labels WHERE digit IN {SCOPE} GROUP BY digit"


@relational("balance_stats", *MA, more={**LABELS, "counts": counts_sql})
def balance_stats(d):
    return """SELECT digit, n, round(CAST(100 * n AS DOUBLE) / (CAST(sum(n) OVER () AS DOUBLE) / 9), 6) AS percent, n < 0.5 * (sum(n) OVER () / 9.0) AS low,
      max(n) OVER () AS most, min(n) OVER () AS least, round(CAST(max(n) OVER () AS DOUBLE) / min(n) OVER (), 6) AS ratio,
      repeat('#', CAST(greatest(1, round(40.0 * n / max(n) OVER ())) AS INT)) AS bar FROM counts"""


@relational("effective_balance", *MA, "synthetic", more={**LABELS, "counts": counts_sql})
def effective_balance(d):
    return f"""SELECT coalesce(c.digit, s.digit) AS digit, coalesce(c.n, 0) AS real_n, coalesce(s.n, 0) AS synthetic_n, coalesce(c.n, 0) + coalesce(s.n, 0) AS effective_n
      FROM counts c FULL OUTER JOIN (SELECT digit, count(*) AS n FROM synthetic WHERE digit IN {SCOPE} GROUP BY digit) s ON c.digit = s.digit"""


@relational("missing_classes", *MA, more={**LABELS, "counts": counts_sql})
def missing_classes(d):
    digits = " UNION ALL ".join(f"SELECT '{k}' AS digit" for k in range(10))
    return f"SELECT digit FROM ({digits}) t WHERE digit NOT IN (SELECT digit FROM counts WHERE n >= 50)"


@relational("class_weights", *MA, more={**LABELS, "counts": counts_sql})
def class_weights(d):
    return "SELECT digit, n, round(CAST(sum(n) OVER () AS DOUBLE) / (9.0 * greatest(n, 1)), 9) AS weight FROM counts"


@relational("stratified_split", *MA, more=LABELS)
def stratified_split(d):
    n = f"greatest(1, {d.int(d.even('count(*) OVER (PARTITION BY digit) * 0.15'))})"
    return f"""SELECT crop_id, digit, CASE WHEN row_number() OVER (PARTITION BY digit ORDER BY md5(concat('{SEED}|', CAST(crop_id AS VARCHAR(20)))), crop_id) <= {n} THEN 'val' ELSE 'train' END AS part
      FROM labels WHERE digit IN {SCOPE}"""


def fold_sql(d):
    return f"SELECT crop_id, digit, CAST((row_number() OVER (PARTITION BY digit ORDER BY md5(concat('{SEED}|', CAST(crop_id AS VARCHAR(20)))), crop_id) - 1) % {FOLDS} AS BIGINT) AS fold FROM labels WHERE digit IN {SCOPE}"


@relational("kfold", *MA, more=LABELS)
def kfold(d):
    return fold_sql(d)


@relational("split_with_synthetic", *MA, "synthetic", more={**LABELS, "folds": fold_sql})
def split_with_synthetic(d):
    """A synthetic row follows its source's fold; rows of unknown sources go."""
    return "SELECT crop_id, digit, fold, false AS synthetic FROM folds UNION ALL SELECT s.crop_id, s.digit, f.fold, true FROM synthetic s JOIN folds f ON f.crop_id = s.source_crop_id"


def turns(real: DataFrame, previous: DataFrame, digits: list[str], target: int | None) -> DataFrame:
    """digit, source_crop_id, turn, aug_index: the synthetic rows that bring each digit to target, dealt to its sources in turn.

    The target is the rounded mean over the classes in scope unless given. Rows of earlier runs (previous: digit,
    source_crop_id, index or null) count; numbers go on after the largest one that a source has, so gaps are harmless.
    """
    scope = real.where(f"digit IN {SCOPE}")
    goal = F.lit(target).cast("long") if target else F.bround(F.count("*") / 9).cast("long")
    goal = scope.agg(goal.alias("goal"))
    have = real.where(F.col("digit").isin(digits)).groupBy("digit").agg(F.count("*").alias("n"))
    made = previous.groupBy("digit").agg(F.count("*").alias("made"))
    plan = have.join(made, "digit", "left").crossJoin(F.broadcast(goal)).withColumn("needed", F.col("goal") - F.col("n") - F.coalesce("made", F.lit(0))).where("needed > 0")  # a row a digit
    rows = plan.select("digit", F.col("n").alias("sources"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("needed") - 1)).alias("turn"))
    first = previous.groupBy("source_crop_id").agg((F.max("index") + 1).alias("next"))
    place = F.row_number().over(Window.partitionBy("digit").orderBy("crop_id")) - 1
    own = real.where(F.col("digit").isin(digits)).select("digit", F.col("crop_id").alias("source_crop_id"), place.cast("long").alias("at")).join(first, "source_crop_id", "left")
    dealt = rows.withColumn("at", F.col("turn") % F.col("sources")).join(own, ["digit", "at"])
    return dealt.select("digit", "source_crop_id", "turn", (F.coalesce("next", F.lit(0).cast("long")) + F.floor(F.col("turn") / F.col("sources"))).alias("aug_index"))


def turns_sql(digits: str, target: str, which: str = "true") -> str:
    return f"""SELECT p.digit, s.crop_id AS source_crop_id, k.i AS turn, CAST(s.nxt + k.i // p.n AS BIGINT) AS aug_index
      FROM (SELECT l.digit, l.n, {target} - l.n - coalesce(y.n, 0) AS needed FROM (SELECT digit, count(*) AS n FROM labels WHERE digit IN ({digits}) GROUP BY digit) l
            LEFT JOIN (SELECT digit, count(*) AS n FROM synthetic WHERE {which} GROUP BY digit) y ON y.digit = l.digit) p,
      LATERAL (SELECT unnest(generate_series(0, CAST(greatest(p.needed, 0) AS BIGINT) - 1)) AS i) k
      JOIN (SELECT l.digit, l.crop_id, coalesce(u.nxt, 0) AS nxt, row_number() OVER (PARTITION BY l.digit ORDER BY l.crop_id) - 1 AS at FROM labels l
            LEFT JOIN (SELECT source_crop_id, max(CASE WHEN crop_id % 7 <> 0 THEN crop_id % 50 END) + 1 AS nxt FROM synthetic WHERE {which} GROUP BY source_crop_id) u ON u.source_crop_id = l.crop_id) s
        ON s.digit = p.digit AND s.at = k.i % p.n"""


def previous(spark, sf_dir) -> DataFrame:
    """Earlier synthetic rows; every seventh one's name has no number."""
    return adapter(spark, sf_dir, "synthetic").select("crop_id", "digit", "source_crop_id", F.when(F.col("crop_id") % 7 != 0, F.col("crop_id") % 50).alias("index"))


@frame("topup_plan", turns_sql("'5', '7'", "3000"), (*MA, "synthetic"), LABELS)
def topup_plan(spark, sf_dir):
    """The two rare digits, to a given count."""
    return turns(labels(spark, sf_dir), previous(spark, sf_dir), ["5", "7"], 3000)


@frame("topup_mean", turns_sql(SCOPE[1:-1], f"(SELECT CAST(round_even(count(*) / 9.0, 0) AS BIGINT) FROM labels WHERE digit IN {SCOPE})", "crop_id % 100 = 0"), (*MA, "synthetic"), LABELS)
def topup_mean(spark, sf_dir):
    """All digits in scope, to their rounded mean; a small earlier run."""
    return turns(labels(spark, sf_dir), previous(spark, sf_dir).where("crop_id % 100 = 0"), list("012345678"), None)
