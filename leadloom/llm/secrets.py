"""Secret scans by dictionary-primed zstandard novelty.

Three fixed patterns give base spans.  Besides, every string of 16 or more token characters, letters and digits among
them, that stands in a sensitive context (quoted, assigned or passed near a word such as ``key`` or ``auth``) is a
candidate.  A candidate's novelty is the marginal number of compressed bytes that it adds to CONTEXT_CHARS characters
of text on either side, where the compressor is primed with a dictionary of code words and identifiers, as a share of
what its alphabet could carry.  Words, identifiers, repeated paths and repeats of surrounding text compress well;
random strings don't.  Copies of a candidate in a sensitive context or a base span, and all after it, do not count as
its surroundings, so that a repeated secret is found; where one is found, every occurrence in the text is reported.

Several sensitive words inside one run of token characters give nested candidates: the outermost is measured first, and
if it is not novel, the parts between the words are.  A text is scanned in time linear in its length.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.llm.common import table

KINDS = ("assign", "access", "hex", "novel")
# Fixed values of the contract.
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")

_WORDS = r"(?i:authorization|bearer|auth|credentials?|private[_-]?key|access[_-]?key|client[_-]?secret|signing[_-]?key|session|cookie|pwd|pass|secret|token|key|passwort|clave|motdepasse)"
#: A candidate for the method: token characters after a sensitive word and an assignment, call or header mark.  The
#: word may be a part of an identifier, of whose rest 64 characters at most follow it; then something must part the
#: two.  Dots stand inside a candidate only.
SENSITIVE = re.compile(
    rf"""(?=[ABCKMPSTabckmpst\u017f\u212a])(?:{_WORDS}[A-Za-z0-9_-]{{0,64}}+(?=["'\])\x20\t:=(])["'\])]{{0,2}}[ \t]{{0,4}}(?:=>|:=|[:=(]|\bis\b)?[ \t]{{0,4}}["'(]?|\b{_WORDS}\b)"""
    r"""(?=[A-Za-z0-9+/_=-][A-Za-z0-9+/_.=-]{15})"""
)
#: Runs of token characters; a candidate ends where its run does.
RUN = re.compile(r"[A-Za-z0-9+/_=-]+(?:\.[A-Za-z0-9+/_=-]+)*")
#: Candidates mix letters and digits; long words of any language don't.
_LETTER, _DIGIT = re.compile("[A-Za-z]"), re.compile("[0-9]")
#: Share of the alphabet's capacity from which a candidate counts as incompressible, and text on either side that is compressed along.
NOVELTY, CONTEXT_CHARS = 0.8, 256

#: Code words and identifiers that prime the compressor.
IDENTIFIERS = (
    "abstract access account action active address admin algorithm alias allow amount answer append application argument array assert assign attribute authentication authorization "
    "balance base64 batch before binary boolean bracket branch browser buffer build button bytes cache callback cancel capture category certificate change channel character check "
    "class client clone close cluster code collection column command comment commit compare compile component compress computer condition config configuration connect connection "
    "console constant container content context control controller convert cookie copy count counter create credential current cursor customer database dataset date debug decode "
    "decrypt default define delete dependency deploy description destination device dictionary digest directory disable display document domain double download driver dynamic element "
    "email empty enable encode encrypt endpoint engine entity entry environment error event example exception execute exist expire export expression extension factory failure feature "
    "fetch field file filter final find float folder follow format function generate getter global graph group handle handler hash header height hidden history host html http https "
    "identifier ignore image implement import include index info initialize input insert install instance integer interface internal invalid invoke issue item iterator java javascript "
    "json keyword label language layout length level library license limit link linux list listen load local location lock login logout long lookup loop machine main manager manifest "
    "map master match maximum memory merge message metadata method metric middle minimum mobile mode model module monitor mount multi mutex name namespace network next node normal null "
    "number object offset online open operation operator option order origin output override owner package page panel parameter parent parse partition password path pattern payload "
    "permission phone pipeline platform player plugin pointer policy port position post prefix previous primary print priority private process product production profile program "
    "project property protocol provider proxy public publish push query queue random range reader record redirect reference refresh region register regular relation release reload "
    "remote remove rename render replace report repository request require reset resource response result retry return revision role root route router rule runtime sample schedule "
    "schema scope screen script scroll search second secret section secure select sender sequence server service session setter setting shadow shape share shell signature signing simple "
    "single size socket sort source special split stack start state static statistics status storage store stream string struct style submit subscribe success suffix summary super "
    "support switch symbol synchronize syntax system table target task template temporary terminal test text theme thread time timeout timestamp title token toolbar tools topic total "
    "track transaction transfer transform translate trigger type unique unit unknown update upgrade upload user username utility valid validate value variable vector vendor verify "
    "version video view virtual visible volume warning watch web widget width window word worker workspace write writer xml yaml your zone placeholder changeme example_secret_key "
    "my_access_token_value YOUR_API_KEY_HERE abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 1234567890 0123456789abcdef "
)


@functools.lru_cache(maxsize=1)
def _compressor():
    import zstandard

    prime = zstandard.ZstdCompressionDict((IDENTIFIERS + IDENTIFIERS.upper() + IDENTIFIERS.title().replace(" ", "")).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(level=9, dict_data=prime, write_content_size=False, write_checksum=False, write_dict_id=False)


def _bits(chars: str) -> float:
    """Bits a character of the narrowest usual alphabet that holds chars."""
    size = 0
    if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", chars):
        size = 16
    else:
        size += 10 * bool(re.search("[0-9]", chars)) + 26 * bool(re.search("[a-z]", chars)) + 26 * bool(re.search("[A-Z]", chars)) + 2 * bool(re.search("[+/_.=-]", chars))
    return math.log2(max(2, size))


def novelty(before: str, candidate: str, after: str = "") -> float:
    """Marginal compressed size of candidate among its surroundings, as a share of what its alphabet can carry."""
    pack = _compressor().compress
    around = before + "\n" + after
    marginal = len(pack((around + "\n" + candidate).encode("utf-8", "surrogatepass"))) - len(pack((around + "\n").encode("utf-8", "surrogatepass")))
    return 8 * max(0, marginal - 3) / (len(candidate) * _bits(candidate))  # 3 bytes: a sequence and its literals' header


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the contract's three kinds, in order."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def _candidates(text: str) -> list[list[tuple[int, int]]]:
    """By run of token characters, the candidates that end with it, outermost first."""
    out: list[list[tuple[int, int]]] = []
    at = 0
    while m := SENSITIVE.search(text, at):
        at = m.end()  # a candidate may hold the word of the next one
        if out and at < out[-1][0][1]:
            out[-1].append((at, out[-1][0][1]))
        else:
            out.append([(at, RUN.match(text, at).end())])
    return [run for run in out if run[0][1] - run[0][0] >= 16]


def _mixed(word: str) -> bool:
    return len(word) >= 16 and bool(_LETTER.search(word) and _DIGIT.search(word))


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping spans as one, in order."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s < out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


class _Inside:
    """Whether a span lies inside one of some spans."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.starts, self.ends, last = [], [], -1
        for s, e in sorted(spans):
            last = max(last, e)
            self.starts.append(s)
            self.ends.append(last)

    def __call__(self, a: int, b: int) -> bool:
        i = bisect.bisect_right(self.starts, a) - 1
        return i >= 0 and self.ends[i] >= b


def _around(text: str, a: int, b: int, known: list[tuple[int, int]]) -> tuple[str, str]:
    """Text before and after a candidate without its other copies; before it, only those in known spans count as copies."""
    word, lo = text[a:b], max(0, a - CONTEXT_CHARS)
    before, at = [], lo
    i = max(0, bisect.bisect_left(known, (lo, 0)) - 1)
    while i < len(known) and known[i][0] < a:
        s, e = max(known[i][0], at), min(known[i][1], a)
        if s < e:
            before += [text[at:s], text[s:e].replace(word, " ")]
            at = e
        i += 1
    return "".join(before) + text[at:a], text[b : b + CONTEXT_CHARS + len(word)].replace(word, " ")[:CONTEXT_CHARS]


def _occurrences(text: str, words: set[str]) -> Iterator[tuple[int, int]]:
    """Where any of the words stands by itself; occurrences of one word do not overlap."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for word in words:
        automaton.add_word(word, word)
    automaton.make_automaton()
    free: dict[str, int] = {}
    for last, word in automaton.iter(text):
        a, b = last + 1 - len(word), last + 1
        if a >= free.get(word, 0):
            free[word] = b
            if not (text[a - 1 : a].isalnum() or text[b : b + 1].isalnum()):
                yield a, b


def _novel(text: str, a: int, b: int, known: list[tuple[int, int]]) -> bool:
    before, after = _around(text, a, b, known)
    return novelty(before, text[a:b], after) >= NOVELTY


def novel_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Every occurrence, outside base spans, of strings that are incompressible in some sensitive context."""
    runs = _candidates(text)
    if not runs:
        return []
    inside = _Inside([(s, e) for s, _, e in base])
    known = _union([run[0] for run in runs] + [(s, e) for s, _, e in base])
    found: set[str] = set()
    spans: list[tuple[int, int]] = []
    for run in runs:
        end = run[0][1]
        parts = [(a, b) for (a, _), (b, _) in zip(run, [*run[1:], (end, end)], strict=True)] if len(run) > 1 else []
        for a, b in (run[0], *parts):
            if inside(a, b) or not _mixed(text[a:b]):
                continue
            if text[a:b] in found or _novel(text, a, b, known):
                found.add(text[a:b])
                spans.append((a, b))
                if b == end and a == run[0][0]:
                    break
    if not found:
        return []
    out: list[tuple[int, int, int]] = []
    widest = -1
    for a, b in sorted({*spans, *_occurrences(text, found)}, key=lambda s: (s[0], -s[1])):
        if b > widest:
            widest = b
            if not inside(a, b):
                out.append((a, 3, b))
    return out


def scan(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans and all spans of a whole text; a null text is empty."""
    base = base_spans(text or "")
    return base, sorted(base + novel_spans(text or "", base))


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        both = [scan(x.as_py()) for x in batch.column(1)]
        counts = {f"n_{kind}": pa.array([sum(s[1] == k for s in base) for base, _ in both], pa.int64()) for k, kind in enumerate(KINDS[:3])}
        texts = {"base_sha256": [hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in both], "spans": [joined(every) for _, every in both]}
        yield pa.record_batch({"doc_id": batch.column(0)} | counts | {k: pa.array(v, pa.string()) for k, v in texts.items()})


def find_secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) a row of ``docs(doc_id, text)``.

    A null or empty text has no spans; a null doc_id is a row like any other; repeated rows are returned as often as
    they come; no rows give none; other columns are not read.  Spans are code points, end exclusive, ordered by start
    and then kind.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_scan_batches, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(text: str | None, mark: str = "<secret>") -> str | None:
    """The text with every span replaced by mark; overlapping spans are replaced as one."""
    if not text:
        return text
    out, at = [], 0
    for a, _, b in scan(text)[1]:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join(out) + text[at:]


def redact_secrets(docs: DataFrame) -> DataFrame:
    """docs with secrets in ``text`` replaced and ``n_chars``, where there is one, brought up to date.

    Every row and every other column stays as it is; null and empty texts stay null and empty.
    """

    @F.pandas_udf("string")
    def cleaned(texts):
        return texts.map(redact, na_action="ignore").astype(object)

    out = docs.withColumn("text", cleaned("text"))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and novel spans of every document, as ``find_secrets`` gives them."""
    return find_secrets(table(spark, sf_dir, "documents"))
