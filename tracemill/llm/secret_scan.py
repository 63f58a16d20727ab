"""Secrets in texts: fixed patterns, and zstandard novelty primed with identifier dictionaries.

Pattern kinds are found by regular expressions. The novelty kind looks at further tokens that stand
close behind a sensitive word: it compresses the surrounding text with and without the token, under
a dictionary of common identifiers, and reports tokens whose marginal bytes are close to those of
random characters.
"""

from __future__ import annotations

import functools
import hashlib
import re

import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame

from .kernels import map_batches, text_of

#: Kinds in the order in which spans of equal start are listed.
KINDS = ("assign", "access", "hex", "novel")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
#: Cheap tests (linear-time automata): every text with a span of a fixed pattern passes the first, every text with a novel token both others.
_FIXED = r"""(?i:(?:password|passwd|secret|token|api_?key)["']?\x20*[:=])|AKIA[A-Z0-9]{12}|[0-9a-f]{32}"""
_CONTEXT = r"(?i:key|secret|token|passw|passphrase|pwd|auth|bearer|credential|private|signature|contrase|clave|kennwort|mot de passe)"
_LONG = r"[A-Za-z0-9+/_-]{16}"
_SENSITIVE = re.compile(r"(?:key|secret|token|passw(?:or)?d|passphrase|pwd|auth\w*|bearer|credentials?|private|signature|contrase.a|clave|kennwort|passwort|mot de passe)[^\n]{0,40}\Z", re.I)
_CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{16,}={0,2}")


def _gate(texts: pa.Array) -> pa.Array:
    """False only for texts without any span."""
    return pc.or_(pc.match_substring_regex(texts, _FIXED), pc.and_(pc.match_substring_regex(texts, _CONTEXT), pc.match_substring_regex(texts, _LONG)))


#: Words of code and configuration that a token may consist of without being secret.
IDENTIFIERS = """
access_token account address admin algorithm alias allow api_key application argument array assert async attribute auth authorization await
backend background base64 bearer boolean bucket buffer build bytes cache callback certificate charset class client cluster code collection
column comment commit component config configuration connection console const constant constructor container content context controller
cookie counter create credential credentials current cursor custom data database dataset date datetime debug default define delete
dependency description destination detail device dictionary directory disable display document domain double driver element email enable
encoding encrypt endpoint engine entity environment error event example exception execute export expression extension factory false field
file filename filter float folder format framework function gateway generate global graph group handler hash header hidden history hostname
identifier image implementation import index info initialize input insert install instance integer interface internal invalid iterator
javascript json kernel key keyword label language layout length level library license limit link list listener local location logger login
machine manager mapping master memory message metadata method middleware model module monitor mutable namespace network node notification
number object offset operation operator option optional order output package parameter parent parser password path pattern payload
permission pipeline platform plugin pointer policy position postgres prefix primary priority private process production profile project
property protected protocol provider proxy public publisher query queue random reader record recursive redirect reference refresh region
register release remote remove render repository request require resource response result return revision role root route router runtime
sample schedule schema scope script search secret security select sequence server service session setting signature singleton socket source
stack standard start state static status storage stream string structure style submit subscribe success suffix summary switch symbol
synchronized system table target task template temporary terminal test thread threshold timeout timestamp title token topic trace
transaction transform transport trigger true type undefined union unique update upload user username utility validate value variable
vector verbose version view virtual visible volume warning widget window worker wrapper
0123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 00000000000000000000 xxxxxxxxxxxxxxxxxxxx -------------------- ____________________
"""
_KNOWN = frozenset(re.findall("[a-z]+", IDENTIFIERS.lower()))


@functools.lru_cache(maxsize=1)
def _compressor() -> zstandard.ZstdCompressor:
    words = IDENTIFIERS.split()
    primed = " ".join(words + [w.title() for w in words] + [w.upper() for w in words])
    return zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(primed.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_dict_id=False)


def novelty(token: str, before: str, after: str) -> float:
    """Marginal compressed bytes of a token in its surroundings, for each of its characters."""
    c = _compressor()
    around = (before + "\n" + after).encode("utf-8", "replace")
    return (len(c.compress(around + b"\n" + token.encode())) - len(c.compress(around + b"\n"))) / len(token)


def _worded(token: str, around: str) -> bool:
    """Whether a token of letters is made of whole words (of three letters or more, split at - _ / + and changes of case) of the dictionary or the surroundings."""
    parts = re.findall(r"[A-Z]?[a-z]+|[A-Z]+", token)
    known = set(re.findall(r"[a-z]+", around.lower())) | _KNOWN
    return all(p.lower() in known for p in parts if len(p) > 2)


def spans(text: str, least: float = 0.88, window: int = 400) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all secrets of one text, by start, then kind; code points, end exclusive.

    A novel token has 16 characters or more, stands at most 40 characters behind a sensitive word of its
    line and overlaps no span of a fixed pattern. Its marginal bytes decide; only a token without digits
    that is made of words of the dictionary or of its surroundings is passed over.
    """
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text) if m.end() - m.start() >= 32]
    known = sorted((a, b) for a, _, b in found)
    reach, at, end = [], 0, -1  # candidates come by start, so one pass over the known spans is enough
    for m in _CANDIDATE.finditer(text):
        a, b = m.span()
        while at < len(known) and known[at][0] < b:
            end = max(end, known[at][1])
            at += 1
        if end > a or not _SENSITIVE.search(text, max(0, a - 60), a):
            continue
        before, after = text[max(0, a - window) : a], text[b : b + window]
        if not re.search("[0-9]", m[0]) and _worded(m[0], before + " " + after):
            continue
        if novelty(m[0], before, after) >= least:
            reach.append((a, 3, b))
    return sorted(found + reach)


def written(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)


_NOTHING = hashlib.sha256(b"").hexdigest()


def scan_documents(docs: DataFrame, least: float = 0.88) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, n_novel, base_sha256, spans.

    spans lists kind:start:end (code points, end exclusive) by start, then kind, comma-joined;
    base_sha256 digests the same list without the novelty kind. A null or empty text has no spans.
    `least` is the marginal compressed bytes a character from which a token counts as novel. Rows
    are independent: null ids, repeated rows, an empty table and further columns change nothing.
    Texts of any length are scanned whole.
    """

    def run(batch: pa.RecordBatch):
        texts = text_of(batch)
        n = len(texts)
        counts = {k: [0] * n for k in KINDS}
        digest, listed = [_NOTHING] * n, [""] * n
        some = pc.indices_nonzero(_gate(texts))
        for i, text in zip(some.to_pylist(), texts.take(some).to_pylist(), strict=True):
            found = spans(text, least)
            if found:
                for _, k, _ in found:
                    counts[KINDS[k]][i] += 1
                digest[i] = hashlib.sha256(written([x for x in found if x[1] < 3]).encode()).hexdigest()
                listed[i] = written(found)
        yield {"doc_id": batch.column(0)} | {f"n_{k}": pa.array(v, pa.int64()) for k, v in counts.items()} | {"base_sha256": pa.array(digest, pa.string()), "spans": pa.array(listed, pa.string())}

    return map_batches(docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text"), run, "doc_id long, n_assign long, n_access long, n_hex long, n_novel long, base_sha256 string, spans string")


def redact(docs: DataFrame, mark: str = "[secret]", least: float = 0.88) -> DataFrame:
    """The documents, all columns kept, with every secret's span replaced by `mark`; n_chars, where there, is counted anew.

    Overlapping spans are replaced together. Null texts stay null.
    """
    fields = docs.columns
    at = fields.index("text")

    def run(batch: pa.RecordBatch):
        texts = batch.column(at)
        hit = pc.fill_null(_gate(texts), False)
        if not pc.any(hit).as_py():
            yield batch
            return
        values, flags = texts.to_pylist(), hit.to_pylist()
        for i, flag in enumerate(flags):
            if flag:
                values[i] = _without(values[i], spans(values[i], least), mark)
        columns = [*batch.columns]
        columns[at] = pa.array(values, texts.type)
        if "n_chars" in fields:
            k = fields.index("n_chars")
            changed = pc.and_(hit, pc.is_valid(columns[at]))
            columns[k] = pc.if_else(changed, pc.utf8_length(columns[at]).cast(columns[k].type), columns[k])
        yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return map_batches(docs, run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema))


def _without(text: str, found: list[tuple[int, int, int]], mark: str) -> str:
    out, at = [], 0
    for a, _, b in found:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])
