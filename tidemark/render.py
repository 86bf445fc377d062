"""Markdown of a finished report: a page is a table of blocks, filled from finished facts.

No number is computed here. A block is a format string with a condition on the facts; one with
``each`` is a format string for every row of a list. Format strings know two additions: the
conversions !t and !u escape a text or an address for Markdown, and a format such as
``{n:#headline}`` counts things.
"""

from __future__ import annotations

import datetime as dt
import json
import os
import string
import tempfile
from dataclasses import dataclass, field
from typing import Any

TITLE = "Mood report"
#: The characters that a text and an address must escape, and the colours of the slices.
ESCAPED = {"t": "\\`*_[]<>|~#", "u": "\\<>|"}
COLORS = {"negative": "#D62728", "positive": "#2CA02C", "neutral": "#7F7F7F"}


@dataclass(frozen=True)
class Block:
    text: str
    when: str = "always"
    each: str | None = None
    above: str = ""


#: Wording and layout of the notes that a fired gate leaves, by gate.
NOTES = {
    "thin_day": "Thin day: {headlines:#headline}.",
    "feeds_down": "{responded} of {configured} feeds responded.",
    "single_source": "{share_pct}% of headlines from {source!t}.",
    "low_confidence": "The model was unsure on {unsure} of {headlines}.",
    "stale_feed": "{names} had nothing newer than {hours:g} h.",
}
#: Wording and layout of the page, in order.
PAGE = (
    Block("# {title} — {date}"),
    Block("No headlines for this date.", when="empty"),
    Block("**Mood index: {mood:+.1f}** ({band}) · {n_headlines:#headline} from {n_sources:#source} · model unsure on {n_unsure}", when="full"),
    Block("_{n_late:#later headline} for this date arrived after its index was frozen and {n_late:is|are} not counted._", when="late"),
    Block("_Data notes: {notes}_", when="noted"),
    Block("## Mood at a glance", when="full"),
    Block("```mermaid\n%%{{init: {{\"themeVariables\": {{{colors}}}}}}}%%\npie showData\n{slices}\n```", when="full"),
    Block("{legend}", when="full"),
    Block("## What happened", when="full"),
    Block("_Offline report: no written summary. Every number on this page is computed from the model's labels._", when="unwritten"),
    Block("{lede!t}", when="written"),
    Block("**Clusters:** no clear theme today ({n_headlines:#headline}; clustering needs {min_headlines}).", when="too_few"),
    Block("**Clusters:** no clear theme today.", when="no_theme"),
    Block("- {size:#headline} on {name}: {split} · {share_pct:+.1f}% of the day's movement", when="themes", each="clusters", above="**Clusters:**\n\n"),
    Block("_Themes use the fixed vocabulary: {oov_pct:.1f}% of this day's words ({oov_out} of {oov_all}) are outside it._", when="measured"),
    Block("_Themes use TF-IDF fit on {fit_n:#headline} ({fit_first}–{fit_last})._", when="fitted"),
    Block("## Recommended articles (highest model certainty, not most important)", when="full"),
    Block("{groups}", when="full"),
    Block("## Sources", when="full"),
    Block(
        "| {source!t} | {total} | {negative} | {neutral} | {positive} |", when="full", each="sources",
        above="| Source | Headlines | Negative | Neutral | Positive |\n|---|--:|--:|--:|--:|\n",
    ),
    Block("<details>\n<summary>All {n_headlines:#headline}</summary>", when="full"),
    Block("| {label} | {sure} | {shown} | {source!t} |", when="full", each="headlines", above="| Sentiment | Certainty | Headline | Source |\n|---|--:|---|---|\n"),
    Block("</details>", when="full"),
    Block("---"),
    Block("Certainty is the model's confidence in its label; below {low_confidence_pct}% it is marked unsure."),
    Block(
        "\"Of the day's movement\" is a headline's certainty over the sum of every non-neutral headline's certainty: "
        "its part in moving the index. Neutral headlines move it by 0."
    ),
    Block("Links go to the original publisher; some limit free articles."),
    Block("Model: {model_id} · Gates: {gates} · Not financial advice."),
)
#: A group of recommended articles, in order.
GROUP = (
    Block("### {Name}"),
    Block("No {name} headlines today.", when="empty"),
    Block("- {shown} · {sure}{moved} · {source!t}", when="full", each="items"),
    Block("_Only {n:#{name} headline} today._", when="short"),
)
#: Parts of lines, chosen by a fact.
SHOWN = {True: "[{title!t}](<{url!u}>)", False: "{title!t}"}
SURE = {True: "{certainty_pct}% (unsure)", False: "{certainty_pct}%"}
MOVED = {True: "", False: " · {contribution_pct:.1f}% of the day's movement"}
JUDGED = {0: "{n_passed}/{n_applicable} passed", 1: ", {n_not_applicable} not applicable", 2: " · {n_notes:#data note}"}


class _Markdown(string.Formatter):
    def convert_field(self, value: Any, conversion: str | None) -> Any:
        if conversion not in ESCAPED:
            return super().convert_field(value, conversion)
        flat = " ".join(value.split()) if conversion == "t" else value
        return flat.translate({ord(c): f"\\{c}" for c in ESCAPED[conversion]})

    def format_field(self, value: Any, spec: str) -> str:
        if spec.startswith("#"):
            return f"{value} {spec[1:]}{'s' * (value != 1)}"
        if "|" in spec:
            return spec.split("|")[value != 1]
        return super().format_field(value, spec)


_fill = _Markdown().format


def text(s: str) -> str:
    return _fill("{!t}", s)


def url(s: str) -> str:
    return _fill("{!u}", s)


@dataclass
class Report:
    date: dt.date
    mood: float | None
    band: str | None
    n_headlines: int
    n_sources: int
    n_unsure: int
    headlines: list[dict]
    slices: list[dict]
    recommended: list[tuple[str, int, list[dict]]]
    sources: list[dict]
    model_id: str
    n_late: int = 0
    low_confidence_pct: int = 60
    gates: dict[str, Any] | None = None
    lede: str | None = None
    clusters: list[dict] | None = None
    fit: tuple[int, dt.date, dt.date] | None = None
    oov: tuple[float, int, int] | None = None
    extra: dict = field(default_factory=dict)


def _laid(blocks: tuple[Block, ...], facts: dict) -> str:
    out = []
    for b in blocks:
        if facts[b.when]:
            lines = [facts | row for row in facts[b.each]] if b.each else [facts]
            out.append(b.above + "\n".join(_fill(b.text, **line) for line in lines))
    return "\n\n".join(out)


def _line(h: dict) -> dict:
    """A headline with the parts of its line."""
    chosen = {"shown": SHOWN[bool(h.get("linked"))], "sure": SURE[bool(h["unsure"])], "moved": MOVED[h.get("contribution_pct") is None]}
    return h | {name: _fill(form, **h) for name, form in chosen.items()}


def _group(name: str, wanted: int, items: list[dict]) -> str:
    n = len(items)
    return _laid(GROUP, {
        "always": True, "empty": n == 0, "full": n > 0, "short": 0 < n < wanted, "name": name, "Name": name.capitalize(), "n": n, "items": list(map(_line, items)),
    })


def _theme(c: dict) -> dict:
    parts = [(c[f"n_{side}"], side) for side in ("negative", "positive", "neutral")]
    return c | {"name": ", ".join(map(text, c["name"])), "split": ", ".join(f"{n} {side}" for n, side in parts if n)}


def _listed(names: list[str]) -> str:
    """a, b and c"""
    return " and ".join(", ".join(part) for part in (list(map(text, names[:-1])), list(map(text, names[-1:]))) if part)


def _facts(r: Report, title: str) -> dict:
    full, written = r.n_headlines > 0, r.lede is not None
    pie = sorted((s for s in r.slices if s["pie_rank"]), key=lambda s: s["pie_rank"])
    named = [s | {"name": s["sentiment"].capitalize()} for s in pie]
    judged = r.gates and r.gates | {"n_notes": len(r.gates.get("notes") or ())}
    parts = (True, judged.get("n_not_applicable"), judged["n_notes"]) if judged else ()
    notes = [_fill(NOTES[gate], **{"hours": 36} | seen | {"names": _listed(seen.get("stale", ()))}) for gate, seen in (judged or {}).get("notes") or ()]
    fit, oov = r.fit or (0, r.date, r.date), r.oov or (0.0, 0, 0)
    return vars(r) | {
        "title": title, "date": r.date.isoformat(), "always": True, "empty": not full, "full": full, "late": full and r.n_late, "noted": notes,
        "notes": " ".join(notes), "written": full and written, "unwritten": full and not written, "measured": full and written and r.oov, "fitted": full and written and r.fit,
        "too_few": full and written and r.clusters is None, "no_theme": full and written and r.clusters == [], "themes": full and written and r.clusters,
        "min_headlines": r.extra.get("min_headlines", 8), "clusters": list(map(_theme, r.clusters or ())), "fit_n": fit[0], "fit_first": fit[1].isoformat(),
        "fit_last": fit[2].isoformat(), "oov_pct": oov[0], "oov_out": oov[1], "oov_all": oov[2], "headlines": list(map(_line, r.headlines)),
        "groups": "\n\n".join(_group(*g) for g in r.recommended), "colors": ", ".join(f'"pie{i}": "{s.get("color", COLORS[s["sentiment"]])}"' for i, s in enumerate(pie, 1)),
        "slices": "\n".join(f'    "{s["name"]}" : {s["count"]}' for s in named),
        "legend": " · ".join(f"{s['sentiment'].capitalize()} {s['count']} ({s['share_pct']:.1f}%)" for s in r.slices),
        "gates": "".join(_fill(JUDGED[i], **judged) for i, there in enumerate(parts) if there) or "not evaluated",
    }


def markdown(r: Report, title: str = TITLE) -> str:
    return _laid(PAGE, _facts(r, title)) + "\n"


def metrics_table(rows: list[dict]) -> str:
    """Markdown table of metric rows (method, accuracy, macro_f1, weighted_f1, recall)."""
    head = "| Method | Accuracy | Macro-F1 | Weighted-F1 | Recall neg / neu / pos |\n|---|--:|--:|--:|--:|\n"
    pct = lambda x: f"{100 * x:.2f} %"
    line = lambda r: f"| {r['method']} | {pct(r['accuracy'])} | {pct(r['macro_f1'])} | {pct(r['weighted_f1'])} | {' / '.join(f'{100 * r["recall"][k]:.2f}' for k in ('negative', 'neutral', 'positive'))} |"
    return head + "\n".join(map(line, rows)) + "\n"


def metrics_text(rows: list[dict], confusion: list[dict]) -> str:
    """Plain text of metric rows (as in ``metrics_table``) and of one confusion table (y_true and a count a label)."""
    names = [k for k in confusion[0] if k != "y_true"] if confusion else []
    out = [f"{r['method']}: accuracy {r['accuracy']:.4f}, macro-F1 {r['macro_f1']:.4f}, weighted-F1 {r['weighted_f1']:.4f}, n {r['n']}" for r in rows]
    out += ["true \\ predicted".ljust(18) + "".join(n.rjust(10) for n in names)] if names else []
    out += [r["y_true"].ljust(18) + "".join(str(r[n]).rjust(10) for n in names) for r in confusion]
    return "\n".join(out) + "\n"


def speed_text(rows: list[dict]) -> str:
    """Plain text of latencies (name, n, p50, p95, most in seconds, rows_per_second)."""
    form = "{name}: {n} runs, p50 {p50:.4f} s, p95 {p95:.4f} s, slowest {most:.4f} s, {rows_per_second:.1f} rows/s"
    return "".join(form.format(**r) + "\n" for r in rows)


def write_history(path: str, history: list[dict]) -> None:
    """The training history so far; written after every epoch, so a stopped run leaves whole epochs."""
    write_atomic(path, json.dumps(history, indent=2) + "\n")


def replace_region(doc: str, name: str, body: str) -> str:
    """The document with the text between its two markers replaced; the rest is untouched."""
    start, end = f"<!-- {name}:start -->", f"<!-- {name}:end -->"
    if start not in doc or end not in doc:
        raise ValueError(f"the document has no {name!r} region")
    return doc[: doc.index(start) + len(start)] + "\n" + body.rstrip("\n") + "\n" + doc[doc.index(end) :]


def write_atomic(path: str, content: str) -> None:
    """Replace a file in one step; nothing is left behind on failure."""
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    handle, temporary = tempfile.mkstemp(dir=folder)
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            f.write(content)
        os.replace(temporary, path)
    except BaseException:
        os.unlink(temporary)
        raise
