"""Mixing sources to target weights: hierarchical budgeting. DataFrame functions only.

A tree domain > language > source has a weight at every node. The token budget goes down the tree; at each
node it is shared among the children by weight, none getting more than its subtree can supply in
``max_epochs`` passes. What a child cannot supply goes to its siblings first; only what the whole subtree cannot
supply was never given to it, so it stays with the ancestor's other children. Shares are whole tokens (rounded
down). A leaf's documents are then taken in a seeded order, a new order for each epoch: whole epochs first, then
the shortest prefix that reaches the rest of the budget.

Cases: null domain, language or source is a node named ``(null)``; a node without a listed weight has weight 1;
weights of zero or less get nothing. Null and empty texts have no tokens: they count as selected only with
whole epochs. Repeated rows are separate rows; those of equal id and token count in a leaf have the same place in its
order and are taken together. An empty table gives an empty result. Added columns replace any of the same name; helper
columns take names that the input lacks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from polyspark.llm.common import BROADCAST_LIMIT, free_prefix, materialize
from polyspark.llm.quality_rules import words_of

DOMAIN = "CASE WHEN source IN ('src0', 'src1', 'src2', 'src3', 'src4') THEN 'web' WHEN source IN ('src5', 'src6', 'src7', 'src8', 'src9') THEN 'forum' ELSE 'reference' END"
DOMAIN_WEIGHTS = {"web": 30, "forum": 30, "reference": 40}
LANG_WEIGHTS = {"en": 55, "de": 15, "fr": 15, "es": 15}
SEED = 17
MAX_EPOCHS = 4
#: Rows of a leaf that one window group holds, about.
ROWS_PER_BUCKET = 4096
#: Parts of each leaf where there are too many leaves to broadcast.
SALTS = 64

LEVELS = ("domain", "lang", "source")


def _weight(name: str, weights: dict[str, int]):
    out = F.lit(1).cast("long")
    for k, v in weights.items():
        out = F.when(F.col(name) == k, F.lit(max(0, v)).cast("long")).otherwise(out)
    return out


def _share(nodes: DataFrame, parents: list[str], name: str) -> DataFrame:
    """Gives each child of a node its ``budget`` of the node's ``parent_budget``, in proportion to ``weight`` up to ``cap``.

    Children in order of cap over weight are full as long as their cap is below their share of what is left;
    the others share the rest by weight. Exact in whole numbers.
    """
    rate = F.when(F.col("weight") > 0, F.col("cap") / F.col("weight")).otherwise(F.lit(float("inf")))
    by = Window.partitionBy(*parents).orderBy(rate, name)
    big = lambda c: F.col(c).cast("decimal(19,0)")
    out = nodes.withColumns(
        {
            "__before": F.coalesce(F.sum("cap").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
            "__open": F.sum("weight").over(by.rowsBetween(0, Window.unboundedFollowing)),
        }
    )
    full = (F.col("weight") > 0) & (big("cap") * big("__open") <= (F.col("parent_budget") - F.col("__before")).cast("decimal(19,0)") * big("weight"))
    out = out.withColumn("__full", full)
    group = Window.partitionBy(*parents)
    out = out.withColumns(
        {
            "__used": F.sum(F.when(F.col("__full"), F.col("cap")).otherwise(0)).over(group),
            "__rest": F.sum(F.when(F.col("__full"), 0).otherwise(F.col("weight"))).over(group),
        }
    )
    part = F.expr("try_divide(CAST(parent_budget - __used AS DECIMAL(19,0)) * CAST(weight AS DECIMAL(19,0)), CAST(__rest AS DECIMAL(19,0)))")
    return out.withColumn("budget", F.when(F.col("__full"), F.col("cap")).otherwise(F.coalesce(F.floor(part).cast("long"), F.lit(0)))).drop(
        "__before", "__open", "__full", "__used", "__rest"
    )


def budgets(leaves: DataFrame, budget: int | None, max_epochs: int, domain_weights: dict, lang_weights: dict, source_weights: dict) -> DataFrame:
    """``leaves`` has the three keys, ``docs`` and ``supply``; adds ``budget``. ``budget`` None stands for all tokens there are."""
    leaf = leaves.withColumns({"cap": F.col("supply") * max_epochs, "weight": _weight("source", source_weights), "root": F.lit(0)})
    lang = leaf.groupBy("root", "domain", "lang").agg(F.sum("cap").alias("cap"), F.sum("supply").alias("supply"))
    domain = lang.groupBy("root", "domain").agg(F.sum("cap").alias("cap"), F.sum("supply").alias("supply"))
    total = F.sum("supply").over(Window.partitionBy("root")) if budget is None else F.lit(budget).cast("long")
    domain = domain.withColumns({"weight": _weight("domain", domain_weights), "parent_budget": total})
    domain = _share(domain, ["root"], "domain").select("domain", F.col("budget").alias("parent_budget"))
    lang = lang.withColumn("weight", _weight("lang", lang_weights)).join(domain, "domain")
    lang = _share(lang, ["domain"], "lang").select("domain", "lang", F.col("budget").alias("parent_budget"))
    leaf = leaf.join(lang, ["domain", "lang"])
    return _share(leaf, ["domain", "lang"], "source").select(*LEVELS, "docs", "supply", "budget")


def mix(
    docs: DataFrame,
    budget: int | None = None,
    domain: str = DOMAIN,
    max_epochs: int = MAX_EPOCHS,
    seed: int = SEED,
    domain_weights: dict | None = None,
    lang_weights: dict | None = None,
    source_weights: dict | None = None,
) -> DataFrame:
    """Adds ``domain``, ``n_tokens`` (words), ``leaf_budget`` and ``copies`` (how often the document is taken) to every row.

    Texts are read twice, to count words and for the result, and never cross a shuffle: the last document of
    each leaf's prefix is found on narrow rows, then each row decides for itself by its order key.
    """
    at = free_prefix(docs)
    keys = [f"{at}{k}" for k in LEVELS]
    docs = docs.drop("leaf_budget", "copies")
    rows = docs.withColumns(
        {k: F.coalesce(F.expr(domain) if n == "domain" else F.col(n), F.lit("(null)")) for k, n in zip(keys, LEVELS)}
        | {"n_tokens": F.size(words_of(F.col("text"))).cast("long"), f"{at}id": F.coalesce(F.col("doc_id").cast("string"), F.lit(""))}
    )
    narrow = materialize(rows.select(*keys, "n_tokens", f"{at}id"), "mixing-tokens")
    leaves = narrow.groupBy(*keys).agg(F.count("*").alias("docs"), F.sum("n_tokens").alias("supply"))
    leaves = leaves.select(*[F.col(k).alias(n) for k, n in zip(keys, LEVELS)], "docs", "supply")
    leaves = budgets(leaves, budget, max_epochs, domain_weights or DOMAIN_WEIGHTS, lang_weights or LANG_WEIGHTS, source_weights or {})
    leaves = leaves.select(
        *[F.col(n).alias(k) for k, n in zip(keys, LEVELS)],
        F.col("budget").alias("leaf_budget"),
        F.expr("coalesce(try_divide(budget, supply), 0)").cast("long").alias(f"{at}epochs"),
        F.expr("CASE WHEN supply = 0 THEN 0 ELSE budget % supply END").alias(f"{at}left"),
        # a bucket is a prefix of the order key, longer the more rows the leaf has
        F.ceil(F.log(F.greatest(F.col("docs") / ROWS_PER_BUCKET, F.lit(1.0))) / F.log(F.lit(16.0))).cast("int").alias(f"{at}digits"),
    )
    leaves = materialize(leaves, "mixing-leaves")
    order = F.md5(F.concat_ws(":", F.lit(seed), f"{at}epochs", f"{at}id", "n_tokens"))
    ordered = _with_leaf(narrow, leaves, keys, at).withColumn(f"{at}order", order)
    last = _cut_off(ordered.withColumn(f"{at}bucket", F.substring(f"{at}order", F.lit(1), F.col(f"{at}digits"))), keys, at)
    leaves = materialize(leaves.join(last, keys, "left"), "mixing-leaves")
    taken = (F.col("n_tokens") > 0) & (order <= F.col(f"{at}last"))
    rows = _with_leaf(rows, leaves, keys, at).withColumns(
        {"copies": F.col(f"{at}epochs") + F.coalesce(taken, F.lit(False)).cast("long"), "domain": F.col(keys[0])}
    )
    return rows.drop(*[c for c in rows.columns if c.startswith(at)])


def _with_leaf(rows: DataFrame, leaves: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Every row with the columns of its leaf: broadcast below the limit, else by salted keys, since one leaf may hold a third of all rows."""
    size = leaves.agg(F.sum(sum((F.length(k) for k in keys), F.lit(0)) * 4 + 128)).first()[0] or 0
    if size <= BROADCAST_LIMIT:
        return rows.join(F.broadcast(leaves), keys)
    salt = f"{at}salt"
    rows = rows.withColumn(salt, F.pmod(F.xxhash64(f"{at}id", "n_tokens"), F.lit(SALTS)))
    return rows.join(leaves.withColumn(salt, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), [*keys, salt]).drop(salt)


def _cut_off(ordered: DataFrame, keys: list[str], at: str) -> DataFrame:
    """``keys, last``: the order key of the last row that a leaf's prefix takes. No row for leaves without one.

    Tokens are summed for each bucket of order keys; the bucket in which the prefix ends is then read row by row.
    """
    bucket, left, start = f"{at}bucket", f"{at}left", f"{at}start"
    sums = ordered.groupBy(*keys, bucket, left).agg(F.sum("n_tokens").alias(start))
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn(start, F.coalesce(F.sum(start).over(before), F.lit(0))).filter(F.col(start) < F.col(left))
    ends = sums.groupBy(*keys).agg(F.max(F.struct(bucket, start)).alias("end")).select(*keys, f"end.{bucket}", f"end.{start}")
    ends = materialize(ends.withColumnRenamed(bucket, f"{at}end"), "mixing-ends")
    inside = _with_leaf(ordered, ends, keys, at).filter(F.col(bucket) == F.col(f"{at}end"))
    inside = inside.groupBy(*keys, f"{at}order", left, start).agg(F.sum("n_tokens").alias("n_tokens"))
    upto = Window.partitionBy(*keys).orderBy(f"{at}order").rowsBetween(Window.unboundedPreceding, -1)
    inside = inside.withColumn("n_tokens", F.col(start) + F.coalesce(F.sum("n_tokens").over(upto), F.lit(0))).filter(F.col("n_tokens") < F.col(left))
    return inside.groupBy(*keys).agg(F.max(f"{at}order").alias(f"{at}last"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    return mix(docs).select("doc_id", "domain", "lang", "source", "n_tokens", "leaf_budget", "copies")


def _cases(name: str, weights: dict) -> str:
    return f"CASE {name} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in weights.items()) + " ELSE 1 END"


def _share_sql(table: str, parents: str, name: str, keep: str) -> str:
    return f"""SELECT {keep}, CASE WHEN is_full THEN cap ELSE coalesce((parent_budget - used) * weight // nullif(rest, 0), 0) END AS budget FROM (
    SELECT *, sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER (PARTITION BY {parents}) AS used,
           sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER (PARTITION BY {parents}) AS rest FROM (
      SELECT *, weight > 0 AND cap * open_weight <= (parent_budget - before_cap) * weight AS is_full FROM (
        SELECT *, coalesce(sum(cap) OVER (PARTITION BY {parents} ORDER BY cap / weight, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_cap,
               sum(weight) OVER (PARTITION BY {parents} ORDER BY cap / weight, {name} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight
        FROM {table})))"""


SQL = f"""
WITH d AS (
  SELECT doc_id, lang AS lang0, source AS source0, coalesce({DOMAIN}, '(null)') AS domain, coalesce(lang, '(null)') AS lang, coalesce(source, '(null)') AS source,
         len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''))::BIGINT AS n_tokens
  FROM documents
), leaf AS (
  SELECT domain, lang, source, sum(n_tokens)::HUGEINT AS supply, sum(n_tokens)::HUGEINT * {MAX_EPOCHS} AS cap, 1 AS weight FROM d GROUP BY ALL
), lang_node AS (SELECT domain, lang, sum(cap) AS cap, {_cases('lang', LANG_WEIGHTS)} AS weight FROM leaf GROUP BY domain, lang),
domain_node AS (
  SELECT 0 AS root, domain, sum(cap) AS cap, {_cases('domain', DOMAIN_WEIGHTS)} AS weight, (SELECT sum(supply) FROM leaf) AS parent_budget FROM leaf GROUP BY domain
), domain_budget AS ({_share_sql('domain_node', 'root', 'domain', 'domain')}
), lang_in AS (SELECT l.*, b.budget AS parent_budget FROM lang_node l JOIN domain_budget b USING (domain)),
lang_budget AS ({_share_sql('lang_in', 'domain', 'lang', 'domain, lang')}
), leaf_in AS (SELECT l.*, b.budget AS parent_budget FROM leaf l JOIN lang_budget b USING (domain, lang)),
leaf_budget AS ({_share_sql('leaf_in', 'domain, lang', 'source', 'domain, lang, source, supply')}
), o AS (
  SELECT d.*, budget, CASE WHEN supply = 0 THEN 0 ELSE budget // supply END AS epochs, CASE WHEN supply = 0 THEN 0 ELSE budget % supply END AS rest,
         md5('{SEED}:' || (CASE WHEN supply = 0 THEN 0 ELSE budget // supply END)::VARCHAR || ':' || doc_id::VARCHAR || ':' || n_tokens::VARCHAR) AS k
  FROM d JOIN leaf_budget USING (domain, lang, source)
), p AS (
  SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY k, n_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM o
)
SELECT doc_id, domain, lang0 AS lang, source0 AS source, n_tokens, budget::BIGINT AS leaf_budget,
       (epochs + CASE WHEN start < rest AND n_tokens > 0 THEN 1 ELSE 0 END)::BIGINT AS copies
FROM p
"""
