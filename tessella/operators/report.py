"""Tables for people: CSV rows, a leaderboard in Markdown, a page."""

from __future__ import annotations

import html
import io
import json
from csv import writer

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def hit_rows(hits: DataFrame, most: int = 50) -> DataFrame:
    """Hits as they are exported: at most 50 a query, scores with six places."""
    return hits.where(F.col("rank") <= most).select("qid", "rank", "doc_id", F.format_string("%.6f", F.col("score").cast("double")).alias("score"))


def leaderboard(scored: DataFrame) -> DataFrame:
    """place, run_id, n and the mean metrics of ``scored`` (run_id and per-query metrics), best nDCG first, ties by run."""
    names = ("ndcg10", "recall1", "recall5", "recall10", "mrr10")
    means = scored.groupBy("run_id").agg(F.count("*").alias("n"), *[F.round(F.avg(c), 9).alias(c) for c in names])
    return means.withColumn("place", F.row_number().over(Window.orderBy(F.desc("ndcg10"), "run_id")))


def markdown(board: DataFrame) -> str:
    """A leaderboard as text; runs are few."""
    columns, rows = board.columns, board.orderBy("place").collect()
    lines = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    return "\n".join(lines + ["| " + " | ".join(f"{v:.4f}" if isinstance(v, float) else str(v) for v in r) + " |" for r in rows]) + "\n"


def csv(board: DataFrame) -> str:
    """A leaderboard as CSV text, a line for each run; metrics with six places, times with three."""
    columns, out = board.columns, io.StringIO()
    lines = writer(out, lineterminator="\n")
    lines.writerow(columns)
    for r in board.orderBy("place").collect():
        lines.writerow([f"{v:.3f}" if c.startswith(("search_ms", "embed_ms")) else f"{v:.6f}" if isinstance(v, float) else v for c, v in zip(columns, r, strict=True)])
    return out.getvalue()


def cut_table(cuts: DataFrame, wanted: list[str]) -> str:
    """Means of some cuts (run_id, cut, mean, n) as Markdown, a line for each run; a dash where a run has none."""
    rows: dict[str, dict[str, str]] = {}
    for r in cuts.where(F.col("cut").isin(wanted)).collect():
        rows.setdefault(r.run_id, {})[r.cut] = f"{r.mean:.4f} (n={r.n})"
    lines = ["| run | " + " | ".join(wanted) + " |", "|" + "---|" * (len(wanted) + 1)]
    return "\n".join(lines + [f"| {run} | " + " | ".join(found.get(c, "-") for c in wanted) + " |" for run, found in sorted(rows.items())]) + "\n"


def pair_table(pairs: DataFrame, run_id: str) -> str:
    """The comparisons (pair, run by run) that one run takes part in, as Markdown."""
    rows = [r for r in pairs.orderBy("pair").collect() if run_id in r.pair.split("-", 1) or r.pair.startswith(f"{run_id}-") or r.pair.endswith(f"-{run_id}")]
    verdict = {1: "a", -1: "b", 0: "tie"}
    lines = ["| pair | difference | interval | better |", "|---|---|---|---|"]
    return "\n".join(lines + [f"| {r.pair} | {r.mean_diff:+.4f} | [{r.low:+.4f}, {r.high:+.4f}] | {verdict[r.win]} |" for r in rows]) + "\n"


def as_records(rows: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in rows.collect()]


def summary(board: DataFrame, pairs: DataFrame, cuts: DataFrame, **facts: object) -> str:
    """All of a leaderboard as JSON: facts (versions, the judge, calibration), runs, pairs and cuts."""
    data = {**facts, "runs": as_records(board.orderBy("place")), "pairwise": as_records(pairs.orderBy("pair")), "cuts": as_records(cuts.orderBy("run_id", "cut"))}
    return json.dumps(data, ensure_ascii=False, indent=2, sort_keys=True, default=str) + "\n"


_SCRIPT = """
const el=(n,t)=>{const e=document.createElement(n);if(t!==undefined)e.textContent=t;return e};
for(const [name,rows] of Object.entries(data)){const s=el('section');s.append(el('h2',name+' ('+rows.length+')'));
if(rows.length){const t=el('table'),keys=Object.keys(rows[0]),h=el('tr');keys.forEach(k=>h.append(el('th',k)));t.append(h);
rows.forEach(r=>{const tr=el('tr');keys.forEach(k=>tr.append(el('td',typeof r[k]==='number'?String(+r[k].toFixed(4)):typeof r[k]==='object'?JSON.stringify(r[k]):r[k])));t.append(tr)});s.append(t)}
document.body.append(s)}
"""


def page(board: DataFrame, title: str = "Leaderboard", **tables: DataFrame) -> str:
    """A page of its own: the leaderboard and any further tables (pairwise, cuts, queries, documents, judgments, hits), with their
    rows as JSON in it. Tables of a report are small."""
    data = {"leaderboard": as_records(board.orderBy("place"))} | {name: as_records(t) for name, t in tables.items()}
    text = json.dumps(data, sort_keys=True, ensure_ascii=False, default=str).replace("</", "<\\/")
    return f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title><style>td,th{{padding:2px 8px;text-align:left}}</style><h1>{html.escape(title)}</h1><script>const data={text};{_SCRIPT}</script>\n"
