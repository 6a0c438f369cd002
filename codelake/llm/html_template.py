"""HTML extraction by site template removal.

A page is cut into elements with a tolerant tokeniser (unclosed paragraphs, comments, raw text elements,
pages cut off in the middle), in time linear in its length. Every block's subtree, tag and white-space-normalised text, is hashed, and
so is its slot: the path of tags and class names to it. Spark counts on how many different pages of a host each subtree occurs (page
copies count once). Templates are deleted first:
* a subtree that recurs on `min_pages` or more pages and on `min_share` of its host's pages;
* outside article and main, a whole slot that `min_pages` pages and `min_share` of them have and in which at least `slot_share` of the
  subtrees recur on another page: menus, adverts and footers that a site deals out by turns.
What recurrence can't tell (a host of few pages, a reader's comment) goes by what the page declares: tags and roles of page furniture,
and class names all of whose words say so (`cookie-notice`, `site-header`; not `article-header`). A header or heading inside article or main stays.
What is left inside article or main (of the body if they hold none) is the text: a line for each block.

Hosts differ in size without bound, so pages are never gathered by host: counts are pre-aggregated. A host's templates are bounded
(each is on `min_share` of its pages); if all hosts' are no more than `max_sent` hashes, every task gets them, else they go to the pages by a salted join.

Defined cases: null html is empty; an empty page or one without text gives an empty string; a null or
malformed url is host "", like any other; rows that share a page_id are separate pages; other columns
than the three named are ignored, whatever their names.
"""

from __future__ import annotations

import html as _html
import re
from itertools import accumulate

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .simhash import ensure_checkpoints

_RAW = "script|style|noscript|template|iframe|svg|math|textarea|select|object|canvas|audio|video|title"
# an odd quote is a character like others, so that no tag is scanned twice
_ATTRS = r"""(?>[^>"'/]|"[^"]*"|'[^']*'|["']|/(?!>))*+"""
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(?P<raw>{_RAW})\b{_ATTRS}(?:/>|>.*?(?:</(?P=raw)\s*>|\Z)|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>{_ATTRS})(?P<void>/?)(?:>|\Z)", re.S | re.I)
_ATTR = re.compile(r"""(?<![\w-])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
#: Tags, roles and class words of page furniture; elements without content; block elements.
FURNITURE = frozenset("head nav header footer aside form button menu dialog fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
WORDS = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside ad ads advert adverts advertisement banner promo sponsor sponsored cookie cookies consent gdpr"
    " notice alert comment comments discussion disqus reply replies respond social share sharing related recommended newsletter subscribe signup popup modal overlay widget pagination pager skip toolbar".split()
)
#: Words that may stand beside those in a class name of furniture.
BESIDE = frozenset("site page main global top bottom left right first last primary secondary fixed sticky inner outer box bar block wrap wrapper container list item area section widget slot unit links link button buttons form message text title policy bot js is has desktop mobile wide post posts news google dfp id".split())
HEADERS = frozenset("header masthead banner".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCKS = frozenset("address article blockquote body center dd details div dl dt figcaption figure h1 h2 h3 h4 h5 h6 hr html li main ol p pre section summary table tbody td tfoot th thead tr ul".split()) | FURNITURE
_CLOSED_BY = {"p": BLOCKS, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}, "head": {"body"}}


class Page:
    """Pieces of text in order, and the elements that hold them."""

    def __init__(self, source: str):
        self.texts: list[str | None] = []  # None: a block edge
        self.elements: list[list] = []  # [tag, first piece, last piece + 1, furniture, slot, inside article or main]
        stack: list[int] = []
        blocks: list[int] = []  # places in the stack of what a block may close
        open_: dict[str, int] = {}  # how many of each tag are open
        at = 0

        def close(upto: int) -> None:
            while len(stack) > upto:
                e = self.elements[stack.pop()]
                open_[e[0]] -= 1
                if e[0] in BLOCKS:
                    self.texts.append(None)
                e[2] = len(self.texts)
            while blocks and blocks[-1] >= upto:
                blocks.pop()

        for m in _TOKEN.finditer(source):
            if m.start() > at:
                self.texts.append(_html.unescape(source[at : m.start()]))
            at = m.end()
            tag = m["tag"]
            if tag is None:
                continue
            tag = tag.lower()
            if m["end"]:
                if open_.get(tag):
                    i = len(stack) - 1
                    while self.elements[stack[i]][0] != tag:
                        i -= 1
                    close(i)
                continue
            if tag in BLOCKS:
                while blocks and tag in _CLOSED_BY.get(self.elements[stack[blocks[-1]]][0], ()):
                    close(blocks[-1])
            if tag in VOID or m["void"]:
                self.texts.append(" " if tag == "br" else None if tag == "hr" else "")
                continue
            if tag in BLOCKS:
                self.texts.append(None)
            parent = self.elements[stack[-1]] if stack else None
            within = bool(parent) and (parent[5] or parent[0] in ("article", "main"))
            names = [x for x in _ATTR.findall(m["attrs"])] if m["attrs"] else []
            own = "".join(sorted(re.sub(r"[0-9]+", "", "".join(v).lower()) for n, *v in names if n.lower() == "class"))
            slot = xxhash.xxh64_intdigest(f"{parent[4] if parent else 0}/{tag}.{own}", 5)
            if tag in BLOCKS or tag in _CLOSED_BY:
                blocks.append(len(stack))
            self.elements.append([tag, len(self.texts), 0, _furniture(tag, names, within), slot, within])
            stack.append(len(self.elements) - 1)
            open_[tag] = open_.get(tag, 0) + 1
        if at < len(source) and not re.match(r"<[!/a-zA-Z]", source[at:]):
            self.texts.append(_html.unescape(source[at:]))
        close(0)

    def hashes(self) -> list[int | None]:
        """A hash of each element's subtree that has text, by differences of running sums."""
        sums, count, real, power, last = [0], [0], [0], [1], None
        for x in self.texts:
            y = "\x00" if x is None else " ".join(x.split())
            if y and not y == last == "\x00":  # block edges in a row are one
                last = y
                sums.append((sums[-1] * _BASE + xxhash.xxh64_intdigest(y, 7)) % _PRIME)
                count.append(count[-1] + 1)
                power.append(power[-1] * _BASE % _PRIME)
                real.append(real[-1] + (x is not None))
            else:
                sums.append(sums[-1])
                count.append(count[-1])
                real.append(real[-1])
        return [
            None if real[a] == real[b] else xxhash.xxh64_intdigest(f"{tag}:{(sums[b] - sums[a] * power[count[b] - count[a]]) % _PRIME}", 7) - (1 << 63)
            for tag, a, b, *_ in self.elements
        ]

    def text(self, templates: frozenset[int] = frozenset(), declared: bool = True) -> str:
        """The main text without templates and furniture. declared: by tags, roles and class names too, not by recurrence alone."""
        gone, inside = [0] * (len(self.texts) + 1), [0] * (len(self.texts) + 1)
        found = self.hashes() if templates else []
        for k, (tag, a, b, furniture, slot, within) in enumerate(self.elements):
            if templates and (found[k] in templates or not within and slot - (1 << 63) in templates) or furniture and (declared or tag == "head"):
                gone[a] += 1
                gone[b] -= 1
            elif declared and tag in ("article", "main"):
                inside[a] += 1
                inside[b] -= 1
        gone, inside = list(accumulate(gone)), list(accumulate(inside))
        if not any(x and x.strip() and i and not g for x, i, g in zip(self.texts, inside, gone)):
            inside = [1] * len(self.texts)
        lines, own = [], []
        for x, i, g in zip(self.texts, inside, gone):
            if x is None:
                lines.append("".join(own))
                own = []
            elif i and not g:
                own.append(x)
        lines.append("".join(own))
        return "\n".join(y for x in lines if (y := " ".join(x.split())))


_BASE, _PRIME = 0x5DEECE66D1CE4E5, (1 << 61) - 1


def _furniture(tag: str, names: list[tuple], within: bool) -> bool:
    """Whether an element declares itself page furniture; names: its class, id and role; within: it is inside article or main."""
    if tag in FURNITURE:
        return not (within and tag == "header")
    if tag in ("html", "body", "main"):
        return False
    for name, *values in names:
        value = "".join(values).lower()
        if name.lower() == "role":
            if value in ROLES:
                return True
            continue
        for one in value.split():
            words = [x for x in re.split(r"[0-9_-]+", one) if x]
            said = WORDS.intersection(words)
            if tag == "article":
                said &= {"comment", "comments", "reply", "ad", "advert", "sponsored"}
            if within:
                said -= HEADERS
            if said and all(x in WORDS or x in BESIDE for x in words):
                return True
    return False


def _candidates(batches):
    """(_host, _page, _slot, _hash) of the subtrees of blocks, each once a page; the slot is null inside article and main."""
    for b in batches:
        rows = []
        for host, source in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            page = Page(source or "")
            found = page.hashes()
            whole = xxhash.xxh64_intdigest(page.text(), 9) - (1 << 63)
            own = {(None if within else slot - (1 << 63), h) for (tag, _, _, _, slot, within), h in zip(page.elements, found) if h is not None and tag in BLOCKS and tag not in ("html", "head", "body", "main", "article")}
            rows.append((host, whole, None, None))  # counts the host's pages
            rows += [(host, whole, *x) for x in sorted(own, key=lambda x: (x[0] is None, x))]
        cols = list(zip(*rows)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.int64()))], names=["_host", "_page", "_slot", "_hash"])


def _extract(batches, sent: dict[str, frozenset[int]] | None, declared: bool):
    for b in batches:
        told = [sent.get(h, frozenset()) for h in b.column(3).to_pylist()] if sent is not None else [frozenset(t or ()) for t in b.column(3).to_pylist()]
        texts = [Page(source or "").text(t, declared) for source, t in zip(b.column(2).to_pylist(), told)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], names=["_id", "_url", "text"])


def extract_main_text(
    df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_pages: int = 5, min_share: float = 0.3, slot_share: float = 0.5, declared: bool = True, max_sent: int = 1_000_000, salts: int = 32,
) -> DataFrame:
    """A row for each input row: id, url, text. declared: what declares itself furniture goes as well; else templates alone are cut."""
    ensure_checkpoints(df.sparkSession)
    host = F.lower(F.coalesce(F.regexp_extract(F.col(url_col).cast("string"), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), F.lit("")))
    pages = df.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), F.col(html_col).cast("string").alias("_html"), host.alias("_host"))
    seen = pages.select("_host", "_html").mapInArrow(_candidates, "_host string, _page long, _slot long, _hash long").distinct()
    counts = seen.groupBy("_host", "_slot", "_hash").agg(F.count("*").alias("_n")).checkpoint()
    sums = counts.where("_hash is not null").groupBy("_host", "_slot").agg(F.sum("_n").alias("_all"), F.sum(F.when(F.col("_n") > 1, F.col("_n"))).alias("_again"))
    found = counts.where("_hash is not null").groupBy("_host", "_hash").agg(F.sum("_n").alias("_n"))
    sizes = counts.where("_hash is null").select(F.col("_host").alias("_of"), F.col("_n").alias("_pages"))
    kept = found.where(F.col("_n") >= min_pages).select("_host", F.col("_hash").alias("_gone"), "_n").union(
        sums.where(F.col("_slot").isNotNull() & (F.col("_again") >= F.greatest(F.lit(min_pages), slot_share * F.col("_all")))).select("_host", "_slot", "_all")
    )
    templates = kept.join(sizes, kept["_host"] == sizes["_of"]).where(F.col("_n") >= min_share * F.col("_pages")).select("_host", "_gone").checkpoint()
    kind = {x.name: x.dataType.simpleString() for x in pages.schema}
    out = f"_id {kind['_id']}, _url {kind['_url']}, text string"
    if templates.count() <= max_sent:
        sent: dict[str, list[int]] = {}
        for h, g in templates.collect():  # max_sent rows at most
            sent.setdefault(h, []).append(g)
        known = {h: frozenset(g) for h, g in sent.items()}
        texts = pages.select("_id", "_url", "_html", "_host").mapInArrow(lambda x: _extract(x, known, declared), out)
    else:
        per_host = templates.groupBy("_host").agg(F.collect_list("_gone").alias("_templates")).select(F.col("_host").alias("_of"), "_templates", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_s"))
        salted = pages.withColumn("_salt", F.pmod(F.xxhash64("_id", "_url"), F.lit(salts)).cast("int"))
        both = salted.join(per_host, (F.col("_host") == F.col("_of")) & (F.col("_salt") == F.col("_s")), "left").select("_id", "_url", "_html", "_templates")
        texts = both.mapInArrow(lambda x: _extract(x, None, declared), out)
    return texts.withColumnsRenamed({"_id": id_col, "_url": url_col})


def op5(spark, sf_dir: str) -> DataFrame:
    return extract_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet")).withColumn("n_chars", F.char_length("text").cast("long"))
