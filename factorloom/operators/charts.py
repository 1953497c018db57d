"""Chart types from recognised strings and from a model's label, and what to make of both. Row-wise columns.

Types: ``bar line pie scatter heatmap framework flowchart table other unknown``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that speak for a type, words of lines that say nothing, labels of models, and order of preference.
BAR = ("柱状", "柱形", "条形图", "histogram", "bar chart")
LINE = ("折线图", "走势图", "净值曲线", "line chart", "累计收益曲线", "多空累计")
PIE = ("饼图", "pie chart", "环图", "donut", "占比图")
FLOW = ("流程", "步骤", "flowchart", "→", "->", "智能体", "奖励反馈", "初始种群")
FRAMEWORK = ("演进", "路径", "阶段", "框架", "方法论", "第一阶段", "第二阶段", "第三阶段", "研究框架", "总框架")
TABLE = ("展示名称", "年化收益", "rankic", "icir", "夏普", "最大回撤", "中性化处理")
NOISE = ("资料来源", "数据来源", "请务必阅读", "chatgpt", "华泰研究", "haitong")
LABELS = {
    "bar": "bar", "barchart": "bar", "column": "bar", "line": "line", "linechart": "line", "area": "line", "pie": "pie", "donut": "pie", "scatter": "scatter", "heatmap": "heatmap", "heat": "heatmap",
    "framework": "framework", "infographic": "framework", "roadmap": "framework", "flowchart": "flowchart", "flow": "flowchart", "diagram": "flowchart", "table": "table", "other": "other", "unknown": "unknown",
}
CHINESE_LABELS = (("柱", "bar", 0.5), ("折线", "line", 0.5), ("走势", "line", 0.5), ("饼", "pie", 0.5), ("框架", "framework", 0.55), ("阶段", "framework", 0.55), ("流程", "flowchart", 0.55), ("表", "table", 0.45))
PREFERENCE = {"framework": 3, "flowchart": 3, "table": 3, "line": 2, "bar": 2, "scatter": 2, "heatmap": 2, "pie": 1, "other": 0, "unknown": 0}
#: Order in which equal scores are resolved.
SCORED = ("bar", "line", "pie", "framework", "flowchart", "table")


def _hits(text: Column, words) -> Column:
    low = F.lower(text)
    return reduce(lambda a, b: a + b, (F.when(text.contains(w) | low.contains(w), 1).otherwise(0) for w in words))


def _matching(texts: Column, pattern: str) -> Column:
    return F.size(F.filter(texts, lambda t: t.rlike(pattern)))


def from_texts(texts: Column) -> Column:
    """Struct ``type, confidence`` by the strings recognised in a picture."""
    clean = F.filter(F.transform(F.coalesce(texts, F.array().cast("array<string>")), lambda t: F.trim(t)), lambda t: (t != "") & (_hits(t, NOISE) == 0))
    text = F.array_join(clean, " ")
    pie = F.when(_hits(text, PIE) > 0, 0.9).otherwise(0.0)
    frame = 0.35 * F.least(_hits(text, FRAMEWORK), F.lit(4)) + F.when(text.rlike(r"第[一二三四五六七八九十\d]+阶段"), 0.7).otherwise(0.0)
    frame = frame + F.when(_matching(clean, r"^[1-3][.、．]") >= 2, 0.4).otherwise(0.0)
    wordy = F.size(F.filter(clean, lambda t: (F.length(t) >= 4) & ~t.rlike(r"^[\d.%\-\s]+$")))
    tables = _hits(text, TABLE)
    scores = {
        "bar": F.when(_hits(text, BAR) > 0, 0.9).otherwise(0.0),
        "line": F.when(_hits(text, LINE) > 0, 0.85).otherwise(0.0) + F.when(_matching(clean, r"^(20\d{2}|\d{2}-\d{2}|\d{4}-\d{2})$") >= 3, 0.7).otherwise(0.0),
        "pie": pie,
        "framework": frame + F.when((wordy >= 10) & (pie < 0.5), 0.45).otherwise(0.0),
        "flowchart": 0.3 * F.least(_hits(text, FLOW), F.lit(3)),
        "table": F.when((tables >= 2) | (_matching(clean, r"\d+(\.\d+)?%") >= 5), 0.8 + 0.05 * F.least(tables, F.lit(4))).otherwise(0.0),
    }
    best = F.greatest(*scores.values())
    name = reduce(lambda rest, k: F.when(scores[k] == best, k).otherwise(rest), reversed(SCORED), F.lit("unknown"))
    sure = F.least(best, F.lit(0.95))
    return F.struct(F.when((F.size(clean) == 0) | (sure < 0.25), "unknown").otherwise(name).alias("type"), F.when(F.size(clean) == 0, 0.0).otherwise(sure).alias("confidence"))


def from_label(raw: Column) -> Column:
    """Struct ``type, confidence`` of a model's answer: its last line's first word, else a label somewhere in it, else Chinese."""
    text = F.lower(F.trim(F.coalesce(raw, F.lit(""))))
    lines = F.filter(F.transform(F.split(text, "\n"), lambda t: F.trim(t)), lambda t: t != "")
    word = F.regexp_replace(F.regexp_extract(F.regexp_replace(F.coalesce(F.get(lines, F.size(lines) - 1), F.lit("")), "^[^a-z]*", ""), r"^(\S*)", 1), r"[`'\".,;:()\[\]{}]+$", "")
    known = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])
    kind, sure = F.lit("unknown"), F.lit(0.2)
    for mark, k, c in reversed(CHINESE_LABELS):
        kind, sure = F.when(raw.contains(mark), k).otherwise(kind), F.when(raw.contains(mark), c).otherwise(sure)
    for key, k in reversed(LABELS.items()):
        if key != "flow":
            kind, sure = F.when(text.contains(key), k).otherwise(kind), F.when(text.contains(key), 0.55 if key in ("other", "unknown") else 0.65).otherwise(sure)
    exact = F.element_at(known, word)
    return F.struct(F.when(text == "", "unknown").otherwise(F.coalesce(exact, kind)).alias("type"), F.when(text == "", 0.0).when(exact.isNotNull(), 0.85).otherwise(sure).alias("confidence"))


def fused(model: Column, texts: Column) -> Column:
    """Struct ``type, confidence, why`` of a model's and the strings' structs ``type, confidence``."""
    m, mc, t, tc = model["type"], model["confidence"], texts["type"], texts["confidence"]
    rank = F.create_map(*[F.lit(x) for pair in PREFERENCE.items() for x in pair])
    structure = ("framework", "flowchart")
    higher = F.element_at(rank, t) - F.element_at(rank, m)
    floor = F.lit(0.45)
    rules = [
        ((m == "unknown") & (t == "unknown"), m, F.lit(0.0), "both_unknown"),
        (m == "unknown", t, tc * 0.9, "texts_only"),
        (t == "unknown", m, mc, "model_only"),
        (m == t, m, F.least(0.5 * mc + 0.5 * tc + 0.15, F.lit(0.98)), "agree"),
        ((m == "pie") & t.isin("framework", "flowchart", "table") & (tc >= 0.4), t, F.least(tc + 0.1, F.lit(0.9)), "structure_over_pie"),
        ((t == "table") & (tc >= 0.7) & ~m.isin("table", "bar"), t, tc, "table_wins"),
        (m.isin(*structure) & t.isin(*structure), F.when(tc >= mc, t).otherwise(m), F.greatest(tc, mc), "structure_pair"),
        (mc >= tc + 0.15, m, mc, "model_higher"),
        (tc >= mc + 0.15, t, tc, "texts_higher"),
        ((higher > 0) | ((higher == 0) & (tc >= mc)), t, F.greatest(tc, floor), "preferred_texts"),
    ]
    out = F.struct(m.alias("type"), F.greatest(mc, floor).alias("confidence"), F.lit("preferred_model").alias("why"))
    for fits, kind, sure, why in reversed(rules):
        out = F.when(fits, F.struct(kind.alias("type"), sure.alias("confidence"), F.lit(why).alias("why"))).otherwise(out)
    return out
