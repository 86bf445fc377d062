"""Personal data by anchor expansion.

One Aho-Corasick automaton finds the anchors (at-signs, plus signs, digits, schemes and
identifier cues); a local deterministic parser expands each anchor to its boundaries and
validates it (labels, octets, Luhn, lengths, IBAN remainder). Text away from anchors is
never parsed. Kinds overlap freely; within a kind spans do not.

Base kinds, by their patterns: email, ip, card, phone. Added kinds: url (an address behind
a scheme) and account (an identifier behind a cue such as ``iban``, ``account`` or ``token``).

Defined results: a null text has no spans; ids are carried as they are, null ones too;
repeated rows give repeated results; spans are code points, end exclusive; only id and
text are read. Work is linear in the text, whatever its length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone", "url", "account")
BASE = KINDS[:4]
#: Cues in front of an account, key or document number.
CUES = ("iban", "account", "acct", "konto", "cuenta", "compte", "passport", "ssn", "swift", "token", "api_key", "apikey", "secret", "password")
SCHEMES = ("https", "http", "ftp")
#: Cues whose identifier is one word that may have few digits.
SECRETS = frozenset(("token", "api_key", "apikey", "secret", "password"))

_local = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_domain = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_ip = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_card = re.compile(r"[0-9](?:[ -]?[0-9])+")
_phone = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_url = re.compile(r"[^\s<>\"'`|\\^{}]+")
_host = re.compile(r"(?:[^\s/?#@<>\"'`|\\^{}]*+@)?(?:\[[0-9A-Fa-f:.]++\]|[^\W_][\w-]*+(?:\.[\w-]++)*+)(?::[0-9]{1,5})?(?=[\s/?#.,;:!)\]<>\"'`|\\^{}]|\Z)")
_account = re.compile(r"(?:[ \t]{0,3}(?i:number|no\.?|nr\.?|id|is))?[ \t]{0,3}[:=#]?[ \t]{0,3}[\"']?([A-Za-z0-9](?:[ -]?[A-Za-z0-9]){5})")
_secret = re.compile(r"(?=[^\W\d_]*+[0-9])[A-Za-z0-9]{6,}+")
_word = re.compile(r"[A-Za-z0-9]++(?:-[A-Za-z0-9]++)*+")
_iban = re.compile(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}")

Span = tuple[str, int, int]


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for d in "0123456789":
        a.add_word(d, ("d", 1))
    a.add_word("@", ("@", 1))
    a.add_word("+", ("+", 1))
    a.add_word("://", ("s", 3))
    for c in CUES:
        for form in {c, c.upper(), c.capitalize()}:
            a.add_word(form, ("c", len(c)))
    a.make_automaton()
    return a


_anchors = None


def _octets(found: str) -> bool:
    return all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in found.split("."))


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d = d * 2 if i % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _digits(found: str) -> str:
    return "".join(c for c in found if "0" <= c <= "9")


def iban(found: str) -> bool:
    """ISO 13616: country, check digits and the remainder 1 of 97."""
    flat = found.replace(" ", "").replace("-", "")
    return bool(_iban.fullmatch(flat)) and int("".join(str(int(c, 36)) for c in flat[4:] + flat[:4])) % 97 == 1


def _word_ends(text: str, at: int) -> Iterator[int]:
    """Ends of the words from ``at`` on that are one space apart."""
    while m := _word.match(text, at):
        yield m.end()
        at = m.end() + 1
        if text[m.end() : at] != " ":
            break


def _identifier(text: str, start: int) -> int | None:
    """The end of the identifier that starts after a cue: an IBAN, or words until the last with a digit, four digits at least."""
    ends = []
    for end in _word_ends(text, start):
        if end - start > 67:  # 34 characters with a separator between any two
            break
        ends.append(end)
    for end in reversed(ends):
        if iban(text[start:end]):
            return end
    at = last = start
    for end in _word_ends(text, start):
        if not any(c.isdigit() for c in text[at:end]):
            break
        at, last = end + 1, end
    return last if len(_digits(text[start:last])) >= 4 else None


def _length(url: str) -> int:
    """Length without the punctuation behind it; a bracket stays if the address has an opening one."""
    end, kept = len(url), {"]": "[" in url, ")": "(" in url}
    while end and url[end - 1] in ".,;:!?)]" and not kept.get(url[end - 1]):
        end -= 1
    return end


def spans(text: str | None) -> list[Span]:
    """All spans of a text, by kind as listed, then start."""
    global _anchors
    if not text:
        return []
    if _anchors is None:
        _anchors = _automaton()
    out: dict[str, list[Span]] = {k: [] for k in KINDS}
    email = ip = card = phone = url = account = ip_run = 0
    for last, (kind, width) in _anchors.iter(text):
        at = last - width + 1
        if kind == "d":
            if at >= ip and at >= ip_run:
                if m := _ip.match(text, at):
                    ip = m.end()
                    if _octets(m[0]):
                        out["ip"].append(("ip", at, ip))
                else:  # no later start in this run of digits can do better
                    ip_run = at + 1
                    while ip_run < len(text) and "0" <= text[ip_run] <= "9":
                        ip_run += 1
            if at >= card and (m := _card.match(text, at)):
                card = m.end()
                d = _digits(m[0])
                if 16 <= len(d) <= 19 and luhn(d):
                    out["card"].append(("card", at, card))
        elif kind == "@":
            start = at
            while start > email and text[start - 1] in _local:
                start -= 1
            if start < at and (m := _domain.match(text, at + 1)):
                email = m.end()
                out["email"].append(("email", start, email))
        elif kind == "+":
            if at >= phone and (m := _phone.match(text, at)):
                phone = m.end()
                if 8 <= len(_digits(m[0])) <= 15:
                    out["phone"].append(("phone", at, phone))
        elif kind == "s":
            scheme = next((s for s in SCHEMES if text[max(0, at - len(s)) : at].lower() == s), None)
            if scheme and at - len(scheme) >= url and _host.match(text, last + 1):  # the host ends at a slash, so failures stay short
                url = last + 1 + _length(_url.match(text, last + 1)[0])
                out["url"].append(("url", at - len(scheme), url))
        elif at >= account and not (at and (text[at - 1].isalnum() or text[at - 1] == "_")):
            if not ((m := _account.match(text, last + 1)) and m.start(1) > last + 1):
                continue
            end = _identifier(text, m.start(1))
            if end is None and text[at : last + 1].lower() in SECRETS and (word := _secret.match(text, m.start(1))):
                end = word.end()
            if end is not None:
                account = end
                out["account"].append(("account", m.start(1), account))
    return [s for k in KINDS for s in out[k]]


_span_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = ((x.as_py() or b"").decode("utf-8", "replace") for x in batch.column(1))
        found = [[{"kind": k, "start": a, "end": b} for k, a, b in spans(t)] for t in texts]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, _span_type)], ["doc_id", "spans"])


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans (kind, start, end): one row for each row, one scan, no shuffle."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(_find, "doc_id long, spans array<struct<kind: string, start: int, end: int>>")


def redact(text: str, found: list[Span]) -> str:
    """The text with each span replaced by its kind in brackets; of overlapping spans the first, then longest, counts."""
    out, at = [], 0
    for k, a, b in sorted(found, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{k.upper()}]"]
            at = b
    return "".join([*out, text[at:]])
