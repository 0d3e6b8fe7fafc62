"""The calibrated classifier in SQL: the counterpart of ``classifier.fit_claim_model``.

Both fits go down by a fixed upper bound of the curvature (a quarter of the rows' squares, plus the penalty), so a step never
raises the loss; the bound is inverted once a fold, and a step is one pass over the training rows.
"""

from __future__ import annotations

from tontine import schemas as S
from tontine.plans.registry import step, steps

#: Largest change of a weight at which a fit is done, and its steps at most.
SETTLED, STEPS = "1e-9", 2000

_SCALES = ", ".join(
    f"avg({c}) AS mean_{c}, CASE WHEN stddev_pop({c}) > 0 THEN stddev_pop({c}) ELSE 1e0 END AS scale_{c}" for c in S.MODEL_NUMERIC
)
_NUMBERS = ", ".join(f"({c} - mean_{c}) / scale_{c}" for c in S.MODEL_NUMERIC)
_CATEGORIES = ", ".join(f"'{c}=' || {c}" for c in S.MODEL_CATEGORICAL)

step(
    "fold_count",
    ("split",),
    f"""-- 0: too few rows of a class, so no folds and no calibration
SELECT CASE WHEN min(c) < 2 THEN 0 ELSE least({S.CALIBRATION_FOLDS}, min(c)) END AS k
FROM (SELECT count(*) AS c FROM split WHERE NOT is_test GROUP BY target_has_claim)""",
)
step(
    "coded",
    ("split", "fold_count"),
    f"""SELECT IDpol, is_test, target_has_claim AS y, [{_NUMBERS}] AS numbers, [{_CATEGORIES}] AS categories,
       CASE WHEN NOT is_test THEN (row_number() OVER (PARTITION BY is_test, target_has_claim ORDER BY md5('{S.SEED}:' || IDpol), IDpol) - 1)
            % greatest(k, 1) END AS fold
FROM split, (SELECT {_SCALES} FROM split WHERE NOT is_test), fold_count""",
)
step(
    "slots",
    ("coded",),
    f"""-- place of each category of the training rows, behind intercept and numbers
SELECT category, row_number() OVER (ORDER BY category) + {1 + len(S.MODEL_NUMERIC)} AS i
FROM (SELECT DISTINCT unnest(categories) AS category FROM coded WHERE NOT is_test) WHERE category IS NOT NULL""",
)
step(
    "points",
    ("coded", "slots"),
    f"""SELECT IDpol, any_value(is_test) AS is_test, any_value(y) AS y, any_value(fold) AS fold,
       list_concat({list(range(1, 2 + len(S.MODEL_NUMERIC)))}, coalesce(list(i ORDER BY i) FILTER (WHERE i IS NOT NULL), [])) AS places,
       list_concat(list_concat([1e0], any_value(numbers)), coalesce(list(1e0) FILTER (WHERE i IS NOT NULL), [])) AS parts
FROM (SELECT *, unnest(categories) AS category FROM coded) LEFT JOIN slots USING (category) GROUP BY IDpol""",
)
step(
    "models",
    ("fold_count",),
    "SELECT unnest(CASE WHEN k = 0 THEN [-1] ELSE range(k) END) AS m FROM fold_count",
)
step("width", ("slots",), f"SELECT count(*) + {1 + len(S.MODEL_NUMERIC)} AS d FROM slots")
step(
    "squares",
    ("points",),
    """SELECT fold, i, j, sum(v * w) AS s
FROM (SELECT fold, i, v, unnest(places) AS j, unnest(parts) AS w
      FROM (SELECT fold, places, parts, unnest(places) AS i, unnest(parts) AS v FROM points WHERE NOT is_test))
GROUP BY ALL""",
)
step(
    "bounds",
    ("squares", "models", "width"),
    """-- bound of the curvature of each model, its penalty (none on the intercept) included, beside the unit matrix
SELECT m, i, list_concat(list(coalesce(s, 0e0) / 4 + CASE WHEN i = j AND i > 1 THEN 1e0 ELSE 0e0 END ORDER BY j),
                         list(CASE WHEN i = j THEN 1e0 ELSE 0e0 END ORDER BY j)) AS line
FROM (SELECT m, i, j FROM models, (SELECT unnest(range(1, d + 1)) AS i FROM width), (SELECT unnest(range(1, d + 1)) AS j FROM width))
LEFT JOIN (SELECT m, i, j, sum(s) AS s FROM squares JOIN models ON fold <> m GROUP BY ALL) USING (m, i, j)
GROUP BY m, i""",
)
step(
    "eliminated",
    ("bounds", "width"),
    """SELECT 1 AS turn, m, i, line FROM bounds
UNION ALL
SELECT turn + 1, m, i,
       CASE WHEN i = turn THEN [x / head FOR x IN line] ELSE [x[1] - x[2] * times FOR x IN list_zip(line, top)] END
FROM (SELECT e.*, p.line AS top, p.line[e.turn] AS head, e.line[e.turn] / p.line[e.turn] AS times
      FROM eliminated e JOIN eliminated p ON p.m = e.m AND p.i = e.turn, width WHERE e.turn <= d)""",
)
step("inverse", ("eliminated", "width"), "SELECT m, i, line[d + 1:] AS line FROM eliminated, width WHERE turn = d + 1")
step(
    "descent",
    ("points", "inverse", "models", "width"),
    f"""SELECT 0 AS turn, m, [0e0 FOR x IN range(d)] AS b, 1e0 AS moved FROM models, width
UNION ALL
SELECT any_value(turn) + 1, m, list(b[i] - change ORDER BY i), max(abs(change))
FROM (SELECT turn, m, b, i, list_dot_product(line, slope) AS change
      FROM (SELECT any_value(turn) AS turn, m, any_value(b) AS b, list(coalesce(s, 0e0) + CASE WHEN i > 1 THEN b[i] ELSE 0e0 END ORDER BY i) AS slope
            FROM (SELECT turn, m, b, unnest(range(1, len(b) + 1)) AS i FROM descent WHERE moved >= {SETTLED} AND turn < {STEPS})
            LEFT JOIN (SELECT m, i, sum(miss * v) AS s
                       FROM (SELECT m, miss, unnest(places) AS i, unnest(parts) AS v
                             FROM (SELECT m, places, parts, 1e0 / (1e0 + exp(-list_dot_product(list_select(b, places), parts))) - y AS miss
                                   FROM descent JOIN points ON fold <> m WHERE NOT is_test AND moved >= {SETTLED} AND turn < {STEPS}))
                       GROUP BY m, i) USING (m, i)
            GROUP BY m) JOIN inverse USING (m))
GROUP BY m""",
)
step("weights", ("descent",), "SELECT m, arg_max(b, turn) AS b FROM descent GROUP BY m")
step(
    "held",
    ("points", "weights"),
    """-- margins of each fold by the model that has not seen it, with the smoothed target
SELECT m, f - avg(f) OVER (PARTITION BY m) AS f, avg(f) OVER (PARTITION BY m) AS middle,
       CASE WHEN y = 1 THEN (sum(y) OVER (PARTITION BY m) + 1e0) / (sum(y) OVER (PARTITION BY m) + 2e0)
            ELSE 1e0 / (sum(1 - y) OVER (PARTITION BY m) + 2e0) END AS t
FROM (SELECT m, y, list_dot_product(list_select(b, places), parts) AS f FROM points JOIN weights ON fold = m WHERE NOT is_test)""",
)
step(
    "sigmoids",
    ("held", "weights"),
    f"""SELECT 0 AS turn, m, 0e0 AS a, 0e0 AS c, 1e0 AS moved FROM weights WHERE m >= 0
UNION ALL
SELECT turn + 1, m, a - da, c - dc, greatest(abs(da), abs(dc))
FROM (SELECT any_value(turn) AS turn, m, any_value(a) AS a, any_value(c) AS c, 4 * sum(miss) / count(*) AS dc,
             CASE WHEN sum(f * f) > 0 THEN 4 * sum(miss * f) / sum(f * f) ELSE 0e0 END AS da
      FROM (SELECT turn, m, a, c, f, 1e0 / (1e0 + exp(-(c + a * f))) - t AS miss
            FROM sigmoids JOIN held USING (m) WHERE moved >= {SETTLED} AND turn < {STEPS})
      GROUP BY m)""",
)
step(
    "calibration",
    ("sigmoids", "held"),
    """SELECT m, a, c, middle
FROM (SELECT m, arg_max(a, turn) AS a, arg_max(c, turn) AS c FROM sigmoids GROUP BY m)
JOIN (SELECT m, any_value(middle) AS middle FROM held GROUP BY m) USING (m)""",
)
step(
    "claim_scores",
    ("points", "weights", "calibration"),
    """SELECT IDpol, any_value(y) AS y, avg(1e0 / (1e0 + exp(-CASE WHEN m < 0 THEN f ELSE c + a * (f - middle) END)) ORDER BY m) AS p
FROM (SELECT IDpol, y, m, list_dot_product(list_select(b, places), parts) AS f FROM points, weights WHERE is_test)
LEFT JOIN calibration USING (m) GROUP BY IDpol""",
)
step(
    "claim_auc",
    ("claim_scores",),
    """SELECT (sum(place) FILTER (WHERE y = 1) - np * (np + 1) / 2e0) / nullif(CAST(np AS DOUBLE) * nn, 0) AS auc
FROM (SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2e0 AS place FROM claim_scores),
     (SELECT count(*) FILTER (WHERE y = 1) AS np, count(*) FILTER (WHERE y = 0) AS nn FROM claim_scores)
GROUP BY np, nn""",
)


#: Steps that the iterated ones read again and again.
STORED = ("points", "inverse", "held")


def fitted(*names: str) -> str:
    """``steps`` with the iterated ones allowed, and what they read stored."""
    sql = steps(*names).replace("WITH ", "WITH RECURSIVE ", 1)
    for name in STORED:
        sql = sql.replace(f"\n{name} AS (", f"\n{name} AS MATERIALIZED (")
    return sql
