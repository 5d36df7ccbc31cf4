"""Text of web pages: paragraphs by block tags, then one of three published ways to tell content from boilerplate.

Pages are parsed with the standard library in Arrow batches; each page stands
alone, so nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from millrace.core.session import prepare

_BLOCKS = frozenset("address article aside blockquote body br caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol option p pre section select summary table td textarea tfoot th thead title tr ul".split())
_HIDDEN = frozenset({"head", "script", "style", "noscript", "template"})
_HEADING = re.compile(r"h[1-6]$")
#: Parts of a page that aren't main content.
_ASIDE = frozenset({"nav", "footer", "aside", "header", "form"})
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())

#: A few very frequent words of each language; a caller with longer lists passes them.
STOP_WORDS: dict[str, frozenset[str]] = {
    "en": frozenset("the of and to in a is that it for was on are as with his they at be this from have or by one had not but what all were when we there can an your which their if do will each how them then she many some so these would has more her two him see no could than been who its now my made over did down only way find use may long very after our most".split()),
    "de": frozenset("der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde".split()),
    "fr": frozenset("de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec mais ou son sa aux d l cette comme on nous tout ses leur être avoir elle même deux".split()),
    "es": frozenset("de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos también fue había era muy años hasta desde está".split()),
}


@dataclass
class Paragraph:
    text: str
    link_chars: int
    heading: bool
    aside: bool
    kind: str = ""


class _Pages(HTMLParser):
    """A page's paragraphs, with the tags above them."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[str] = []
        self.out: list[Paragraph] = []
        self.parts: list[str] = []
        self.links = 0
        self.lang = ""

    def _end(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.out.append(Paragraph(text, self.links, any(map(_HEADING.match, self.open)), any(t in _ASIDE for t in self.open)))
        self.parts, self.links = [], 0

    def handle_starttag(self, tag, attrs):
        if tag == "html":
            self.lang = (dict(attrs).get("lang") or "").lower()
        if tag in _BLOCKS:
            self._end()
        if tag not in _VOID:
            self.open.append(tag)

    def handle_endtag(self, tag):
        if tag in _BLOCKS:
            self._end()
        if tag in self.open:
            while self.open.pop() != tag:
                pass

    def handle_data(self, data):
        if not any(t in _HIDDEN for t in self.open):
            self.parts.append(data)
            if "a" in self.open:
                self.links += len(" ".join(data.split()))


def paragraphs(html: str) -> tuple[list[Paragraph], str]:
    """Paragraphs of a page and the language it says it is in."""
    p = _Pages()
    p.feed(html)
    p.close()
    p._end()
    return p.out, p.lang


def _density(text: str, stop: frozenset[str], lower: bool = True) -> float:
    w = (text.lower() if lower else text).split()
    return sum(x in stop for x in w) / len(w) if w else 0.0


def by_context(html: str, stop: frozenset[str], length_low: int = 70, length_high: int = 200, stopwords_low: float = 0.30, stopwords_high: float = 0.32, max_link_density: float = 0.2, max_heading_distance: int = 200, keep_all: bool = False) -> list[str]:
    """Paragraphs by length, stop words and links, short ones by their neighbours (Pomikalek's method).

    ``keep_all`` returns every paragraph, as is right for languages that don't
    put spaces between words.
    """
    ps, _ = paragraphs(html)
    if keep_all:
        return [p.text for p in ps]
    for p in ps:
        n, stops = len(p.text), _density(p.text, stop)
        if p.link_chars > max_link_density * n or "©" in p.text or "&copy" in p.text:
            p.kind = "bad"
        elif n < length_low:
            p.kind = "bad" if p.link_chars else "short"
        elif stops >= stopwords_high:
            p.kind = "good" if n > length_high else "near"
        else:
            p.kind = "near" if stops >= stopwords_low else "bad"

    def to_heading(first: int, want: set[str]) -> bool:
        room = max_heading_distance
        for p in ps[first + 1 :]:
            if p.kind in want:
                return True
            room -= len(p.text)
            if room < 0:
                return False
        return False

    cut = [p.kind for p in ps]
    for i, p in enumerate(ps):  # short headings before good text
        if p.heading and cut[i] == "short" and to_heading(i, {"good"}):
            p.kind = "near"

    def around(i: int, step: int, kinds: list[str], ignore: set[str]) -> str:
        i += step
        while 0 <= i < len(ps):
            if kinds[i] not in ignore:
                return kinds[i]
            i += step
        return "bad"

    kinds = [p.kind for p in ps]
    for i, p in enumerate(ps):
        if kinds[i] == "short":
            left, right = around(i, -1, kinds, {"short", "near"}), around(i, 1, kinds, {"short", "near"})
            near = {left, right}
            if near == {"good"}:
                p.kind = "good"
            elif near == {"bad"}:
                p.kind = "bad"
            else:  # between good and bad, a near-good paragraph on the bad side decides
                side = -1 if left == "bad" else 1
                p.kind = "good" if around(i, side, kinds, {"short"}) == "near" else "bad"
    kinds = [p.kind for p in ps]
    for i, p in enumerate(ps):
        if kinds[i] == "near":
            p.kind = "good" if "good" in {around(i, -1, kinds, {"short", "near"}), around(i, 1, kinds, {"short", "near"})} else "bad"
    for i, p in enumerate(ps):  # headings that were good before context and stand near good text
        if p.heading and p.kind == "bad" and cut[i] != "bad" and to_heading(i, {"good"}):
            p.kind = "good"
    return [p.text for p in ps if p.kind == "good"]


def main_lines(html: str, stop: frozenset[str], required: float = 0.32, main_only: bool = True) -> list[str]:
    """Paragraphs of the main part whose share of stop words, as they stand, is high enough."""
    return [p.text for p in paragraphs(html)[0] if not (main_only and p.aside) and _density(p.text, stop, lower=False) >= required]


def long_blocks(html: str, stop: frozenset[str], required: float = 0.32, least_chars: int = 250, most_repeats: int = 2) -> list[str]:
    """Main paragraphs with few links, each at most ``most_repeats`` times; nothing if they are short altogether; then the stop-word rule."""
    seen: dict[str, int] = {}
    out = []
    for p in paragraphs(html)[0]:
        seen[p.text] = seen.get(p.text, 0) + 1
        if not p.aside and p.link_chars <= 0.5 * len(p.text) and seen[p.text] <= most_repeats:
            out.append(p.text)
    return [t for t in out if _density(t, stop, lower=False) >= required] if sum(map(len, out)) >= least_chars else []


ALGORITHMS: dict[str, Callable[..., list[str]]] = {"context": by_context, "main_lines": main_lines, "long_blocks": long_blocks}


def guess_language(text: str, stops: Mapping[str, frozenset[str]]) -> str | None:
    """The language whose stop words are the largest share of the words; ties go to the name that sorts first."""
    best = max(((_density(text, s), k) for k, s in sorted(stops.items(), reverse=True)), default=(0.0, None))
    return best[1] if best[0] > 0 else None


def decode(raw: bytes | str | None) -> str | None:
    """Bytes as UTF-8, else as what a meta tag names, else as Windows-1252."""
    if raw is None or isinstance(raw, str):
        return raw
    raw = bytes(raw)
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        m = re.search(rb"charset=[\"']?([A-Za-z0-9_-]+)", raw)
        try:
            return raw.decode(m[1].decode() if m else "cp1252", "replace")
        except LookupError:
            return raw.decode("cp1252", "replace")


def extract_text(pages: DataFrame, html_col: str = "html", algorithm: str = "context", stops: Mapping[str, frozenset[str]] | None = None, text_col: str = "text", language_col: str = "language", language: Callable[[str], str | None] | None = None, **options) -> DataFrame:
    """Add ``language`` and ``text`` (paragraphs, a blank line apart); pages without either go.

    The language is what ``language`` says of the page's visible text; by
    default the one whose stop words are most frequent. A page in a language
    without a stop list goes.
    """
    prepare(pages.sparkSession)
    stops = dict(stops or STOP_WORDS)
    fn, at = ALGORITHMS[algorithm], pages.columns.index(html_col)
    keep = [i for i, c in enumerate(pages.columns) if c not in {text_col, language_col}]
    schema = T.StructType([*(pages.schema.fields[i] for i in keep), T.StructField(language_col, T.StringType()), T.StructField(text_col, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, langs, texts = [], [], []
            for i, raw in enumerate(b.column(at).to_pylist()):
                html = decode(raw)
                if not html:
                    continue
                seen = "\n".join(p.text for p in paragraphs(html)[0])
                lang = language(seen) if language else guess_language(seen, stops)
                got = fn(html, stops[lang], **options) if lang in stops else []
                if got:
                    rows.append(i)
                    langs.append(lang)
                    texts.append("\n\n".join(got))
            picked = b.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*(picked.column(i) for i in keep), pa.array(langs, pa.string()), pa.array(texts, pa.string())], names=schema.fieldNames())

    return pages.mapInArrow(run, schema)
