"""Main text of pages by wrappers inferred from pages of the same host.

1. Each page is a stream of tags and text slots. Runs of equal neighbours become repeated groups,
   so that pages of one template have few different streams.
2. The distinct streams of a host are aligned one after another. What matches stays; where two
   streams differ, a part that occurs in one only becomes optional, and a part that is a group's
   body becomes that repeated group. The result is a regular expression without unions. Streams are
   folded in runs of bounded number, and the wrappers of runs are folded again until one is left.
3. Each page is matched with its host's wrapper, so that each of its texts has a place there. The
   places are judged by where they stand and by what all pages of the host have there. A page's
   text is what it has in its host's content slots.
"""

from __future__ import annotations

import gc
import html as html_module
import re
from collections.abc import Iterator
from difflib import SequenceMatcher
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import or_empty, written

#: Streams or wrappers that one task aligns one after another.
FOLD = 64
#: Longest body of a repeated group, in tokens.
BODY = 12
#: Wrappers, and answers for their pages, that a task keeps in memory; more are worked out again.
MATCHERS, ANSWERS = 256, 20_000
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(?=/?[a-zA-Z])[^>]*\Z", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
#: Elements whose content is not markup or not shown.
RAW = frozenset(("script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "xmp", "noembed"))
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that make up a slot's path; the others only part blocks.
REGIONS = frozenset("html head body article main section div nav header footer aside form table ul ol dl figure details dialog menu fieldset button select search".split())
NEVER = frozenset("head nav header footer aside form dialog menu button select fieldset search".split())
MAIN = frozenset(("article", "main"))
#: Words in a class, id or role that mark what is not the article.
MARKED = re.compile(
    r"(?:^|[\s_-])(ads?|advert\w*|banner|sponsor\w*|promo\w*|nav\w*|menu\w*|breadcrumbs?|sidebar|side|rail|footer|foot|header|masthead|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay"
    r"|subscri\w*|newsletter|social|share|sharing|related|recommend\w*|comments?|commentlist|replies|reply|respond|disqus|login|signup|form|widget|toolbar|paginat\w*|pager|copyright|legal|hidden)(?:[\s_-]|$)",
    re.I,
)


def role(tag: str, attributes: str) -> str:
    """How an element stands in a path: its name, with a mark if it is none of the article's."""
    if tag in NEVER:
        return tag + "!"
    if attributes:
        found = {a.lower(): x or y or z for a, x, y, z in ATTRIBUTE.findall(attributes)}
        named = " ".join(found.get(k, "") for k in ("class", "id", "role"))
        if tag not in MAIN and tag not in ("html", "body") and MARKED.search(named):
            return tag + "!"
        if re.search(r"\bhidden\b|display:\s*none", attributes, re.I):
            return tag + "!"
        if found.get("role") == "main" or found.get("itemprop") == "articleBody":
            return "main"
    return tag


def stream(page: str) -> Iterator[tuple[str, str]]:
    """Tags and texts of a page in order: ("<", role), (">", tag), ("-", inline tag), ("#", text). Comments, scripts and styles are left out."""
    at, n = 0, len(page)
    while at < n:
        found = TOKEN.search(page, at)
        if found is None:
            yield "#", page[at:]
            return
        if found.start() > at:
            yield "#", page[at : found.start()]
        at = found.end()
        if found[2] is None:
            continue
        tag = found[2].lower()
        if found[1]:
            yield ("-" if tag in INLINE else ">"), tag
        elif tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            at = close.end() if close else n
        else:
            yield ("-", tag) if tag in INLINE else ("<", role(tag, found[3]) if tag in REGIONS else tag)


class Page:
    """A page's slots in order: path, text, and how much of the text is in links."""

    def __init__(self, page: str):
        self.slots: list[tuple[str, str, int]] = []
        self.tokens: list[str] = []
        path: list[str] = []
        block: list[str] = []
        linked, in_link = 0, False

        def close() -> None:
            nonlocal linked
            text = " ".join("".join(block).split())
            if text:
                self.slots.append(("/".join(path), text, linked))
                self.tokens.append("#" + "/".join(path))
            block.clear()
            linked = 0

        for kind, what in stream(page):
            if kind == "#":
                piece = html_module.unescape(what)
                block.append(piece)
                linked += len(piece) if in_link else 0
            elif kind == "-":
                in_link = (not in_link) if what == "a" else in_link
            else:
                close()
                in_link = False
                name = what.rstrip("!")
                if kind == "<":
                    self.tokens.append(f"<{what}>")
                    if name in REGIONS and name not in VOID:
                        path.append(what)
                else:
                    self.tokens.append(f"</{what}>")
                    names = [p.rstrip("!") for p in path]
                    if name in REGIONS and (name in names or (name in ("div", "section") and "main" in names)):
                        while path and path.pop().rstrip("!") not in (name, *(("main",) if name in ("div", "section") else ())):
                            pass
        close()


def fold_repeats(tokens: list[str]) -> list[str]:
    """Neighbouring equal runs of up to BODY tokens become one repeated group, shortest bodies first."""
    out = tokens
    for body in range(1, BODY + 1):
        done: list[str] = []
        k = 0
        while k < len(out):
            times = 1
            if k + 2 * body <= len(out) and out[k] == out[k + body]:
                piece = out[k : k + body]
                while out[k + times * body : k + (times + 1) * body] == piece:
                    times += 1
            if times > 1:
                group = "(" + "\t".join(piece) + ")+" if body > 1 or not piece[0].endswith(")+") else piece[0]
                done.append(group)
                k += times * body
            else:
                done.append(out[k])
                k += 1
        out = done
    return out


def refold(tokens: list[str], groups: set[str]) -> list[str]:
    """A single occurrence of a known group's body is that group once."""
    for group in sorted(groups, key=len):
        body = group[1:-2].split("\t") if "(" not in group[1:] else None
        if not body:
            continue
        done, k = [], 0
        while k < len(tokens):
            if tokens[k : k + len(body)] == body:
                if not (done and done[-1] == group):
                    done.append(group)
                k += len(body)
            elif tokens[k] == group and done and done[-1] == group:
                k += 1
            else:
                done.append(tokens[k])
                k += 1
        tokens = done
    return tokens


Wrapper = list[tuple[str, bool]]


def align(a: Wrapper, b: Wrapper) -> Wrapper:
    """The wrapper that takes what either takes: matches stay, the rest is optional in its place."""
    groups = {t for t, _ in (*a, *b) if t.endswith(")+")}

    def refolded(w: Wrapper) -> Wrapper:
        if not groups:
            return w
        optional = [o for _, o in w]
        if any(optional):  # optional parts are kept as they are
            return w
        return [(t, False) for t in refold([t for t, _ in w], groups)]

    a, b = refolded(a), refolded(b)
    out: Wrapper = []
    for op, i, j, k, m in SequenceMatcher(None, [t for t, _ in a], [t for t, _ in b], autojunk=False).get_opcodes():
        if op == "equal":
            out += [(t, oa or ob) for (t, oa), (_, ob) in zip(a[i:j], b[k:m], strict=True)]
        else:
            out += [(t, True) for t, _ in (*a[i:j], *b[k:m])]
    return out


def packed(w: Wrapper) -> str:
    return "\n".join(t + ("?" if o else "") for t, o in w)


def unpacked(s: str) -> Wrapper:
    return [(t[:-1], True) if t.endswith("?") else (t, False) for t in s.split("\n") if t]


class Matcher:
    """Finds the places of a page's tokens in a wrapper: a place is a token's number in the wrapper, bodies of groups spread out."""

    def __init__(self, wrapper: Wrapper):
        self.code: list[tuple] = []  # (token, place), or (None, first choice, second choice)
        place = 0
        for unit, optional in wrapper:
            skip = len(self.code)
            if optional:
                self.code.append((None, skip + 1, -1))
            opened: list[int] = []
            for piece in unit.split("\t") if unit.startswith("(") else [unit]:
                token = piece.lstrip("(")
                opened += [len(self.code)] * (len(piece) - len(token))
                closed = 0
                while opened and token.endswith(")+"):
                    token, closed = token[:-2], closed + 1
                self.code.append((token, place))
                place += 1
                for _ in range(closed):
                    self.code.append((None, opened.pop(), len(self.code) + 1))
            if optional:
                self.code[skip] = (None, skip + 1, len(self.code))

    def places(self, tokens: list[str]) -> list[int] | None:
        """The place of each token, optional parts taken and groups repeated as early as that is possible; None if the wrapper does not take the page."""
        code, n, end = self.code, len(tokens), len(self.code)
        tried: set[int] = set()
        left: list[tuple[int, int, tuple | None]] = [(0, 0, None)]
        while left:
            pc, at, taken = left.pop()
            while True:
                if pc == end:
                    if at < n:
                        break
                    out = []
                    while taken:
                        taken, place = taken
                        out.append(place)
                    return out[::-1]
                step = code[pc]
                if step[0] is None:
                    state = pc * (n + 1) + at
                    if state in tried:
                        break
                    tried.add(state)
                    left.append((step[2], at, taken))
                    pc = step[1]
                elif at < n and tokens[at] == step[0]:
                    pc, at, taken = pc + 1, at + 1, (taken, step[1])
                else:
                    break
        return None


class Places:
    """The places of the text slots of pages in their hosts' wrappers; the latest answers are kept."""

    def __init__(self) -> None:
        self.matchers: dict[str, Matcher] = {}
        self.known: dict[tuple[str, str], list[int]] = {}

    def __call__(self, wrapper: str, tokens: str) -> list[int]:
        found = self.known.get((wrapper, tokens))
        if found is None:
            if wrapper not in self.matchers:
                if len(self.matchers) >= MATCHERS:
                    self.matchers.clear()
                    self.known.clear()
                self.matchers[wrapper] = Matcher(unpacked(wrapper))
            split = [t for t in tokens.split("\n") if t]
            places = self.matchers[wrapper].places(split)
            if places is None:
                raise ValueError("a wrapper does not take a page that it was inferred from")
            if len(self.known) >= ANSWERS:
                self.known.clear()
            found = self.known[wrapper, tokens] = [k for t, k in zip(split, places, strict=True) if t.startswith("#")]
        return found


def host_of(column: str = "url"):
    return F.lower(F.coalesce(F.regexp_extract(or_empty(column), r"^\s*[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1), F.lit("")))


def page_facts(pages: DataFrame) -> DataFrame:
    """``host``, ``stream`` (folded), ``tokens`` (not folded), and ``slots``: for each text slot of the page its path, length, length in links, and a hash of its whole text."""
    slot = T.StructType([T.StructField("path", T.StringType()), T.StructField("chars", T.LongType()), T.StructField("linked", T.LongType()), T.StructField("text", T.LongType())])
    schema = T.StructType([T.StructField("host", T.StringType()), T.StructField("stream", T.StringType()), T.StructField("tokens", T.StringType()), T.StructField("slots", T.ArrayType(slot))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()
        for batch in batches:
            streams, tokens, slots = [], [], []
            for raw in batch.column(1):
                page = Page(raw.as_py() or "")
                streams.append("\n".join(fold_repeats(page.tokens)))
                tokens.append("\n".join(page.tokens))
                slots.append([{"path": p, "chars": len(t), "linked": k, "text": hashed(t)} for p, t, k in page.slots])
            kind = pa.list_(pa.struct([("path", pa.string()), ("chars", pa.int64()), ("linked", pa.int64()), ("text", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(streams, pa.string()), pa.array(tokens, pa.string()), pa.array(slots, kind)], schema.names)

    return pages.select(host_of().alias("host"), "html").mapInArrow(run, schema)


def hashed(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def infer(facts: DataFrame) -> DataFrame:
    """One row per host: ``host``, ``wrapper`` (a token a line; ``?``: optional, ``( )+``: repeated, ``#``: text slot)."""
    now = written(facts.select("host", F.col("stream").alias("wrapper")).distinct(), "streams")
    while True:
        most = now.groupBy("host").count().agg(F.max("count")).first()[0] or 0
        if most <= 1:
            return now
        # Runs of similar streams first: in order of a hash of their beginning.
        dealt = now.withColumn("runs", F.lit((most + FOLD - 1) // FOLD)).withColumn("run", F.expr("pmod(xxhash64(wrapper), runs)"))

        def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, held = None, []
            for batch in batches:
                for host, run, wrapper in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                    if (host, run) != at:
                        if at is not None:
                            yield pa.RecordBatch.from_arrays([pa.array([at[0]]), pa.array([packed(held)])], ["host", "wrapper"])
                        at, held = (host, run), unpacked(wrapper)
                    else:
                        held = align(held, unpacked(wrapper))
            if at is not None:
                yield pa.RecordBatch.from_arrays([pa.array([at[0]]), pa.array([packed(held)])], ["host", "wrapper"])

        ordered = dealt.repartition("host", "run").sortWithinPartitions("host", "run", F.length("wrapper"), "wrapper").select("host", "run", "wrapper")
        now = written(ordered.mapInArrow(fold, "host string, wrapper string"), "wrappers")


def placed(facts: DataFrame, wrappers: DataFrame) -> DataFrame:
    """One row per page and place of its host's wrapper: ``host``, ``place``, ``path``, ``chars``, ``linked``, ``text`` (a hash of all texts that the page has there, in order)."""
    schema = T.StructType([T.StructField("host", T.StringType()), T.StructField("place", T.IntegerType()), T.StructField("path", T.StringType()), *[T.StructField(n, T.LongType()) for n in ("chars", "linked", "text")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()
        places = Places()
        for batch in batches:
            rows = []
            for host, tokens, slots, wrapper in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                own: dict[int, list] = {}
                for k, slot in zip(places(wrapper, tokens), slots, strict=True):
                    if k in own:
                        row = own[k]
                        row[3] += slot["chars"]
                        row[4] += slot["linked"]
                        row[5] = hashed(f"{row[5]} {slot['text']}")
                    else:
                        own[k] = [host, k, slot["path"], slot["chars"], slot["linked"], slot["text"]]
                rows += own.values()
            if rows:
                kinds = (pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], schema.names)

    return facts.join(wrappers, "host").select("host", "tokens", "slots", "wrapper").mapInArrow(run, schema)


def content_slots(facts: DataFrame, wrappers: DataFrame) -> DataFrame:
    """``host``, ``wrapper``, ``inner``, ``outer``: the places of the wrapper that hold the article.

    Inner slots are below an article or main element, unless a part of that is marked as something
    else. Outer slots are for pages without text in inner slots: unmarked slots that are not mostly
    links and do not read the same on all of three or more pages that have the place. A repeated
    group's slot is one place, and reads the same if all its repeats do.
    """
    seen = placed(facts, wrappers).groupBy("host", "place", "path").agg(F.count("*").alias("pages"), F.sum("chars").alias("chars"), F.sum("linked").alias("linked"), F.min("text").alias("first"), F.max("text").alias("last"))
    judged = seen.where(~F.col("path").contains("!"))
    inside = F.col("path").rlike("(^|/)(article|main)(/|$)")
    free = (F.col("linked") * 2 <= F.col("chars")) & ((F.col("pages") < 3) | (F.col("first") != F.col("last")))
    judged = judged.groupBy("host").agg(F.collect_set(F.when(inside, F.col("place"))).alias("inner"), F.collect_set(F.when(~inside & free, F.col("place"))).alias("outer"))
    return wrappers.join(judged, "host").select("host", "wrapper", "inner", "outer")


def extracted(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """One row per input row: ``key``, ``url``, ``text``.

    NULL and empty pages, and pages without text in content slots, give an empty text. A NULL or
    unreadable URL belongs to the host of empty name. Repeated rows give repeated rows.
    """
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), or_empty(page).alias("html"))
    facts = written(page_facts(rows), "page-facts")
    slots = written(content_slots(facts, infer(facts)), "content-slots")  # its size decides on a broadcast
    joined = rows.withColumn("host", host_of()).join(slots, "host", "left").select("key", "url", "html", "wrapper", "inner", "outer")
    schema = T.StructType([rows.schema["key"], rows.schema["url"], T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()
        places = Places()
        for batch in batches:
            texts = []
            for raw, wrapper, inner, outer in zip(batch.column(2), *[batch.column(k).to_pylist() for k in (3, 4, 5)], strict=True):
                page = Page(raw.as_py())
                slots = list(zip(places(wrapper, "\n".join(page.tokens)), [t for _, t, _ in page.slots], strict=True)) if wrapper is not None else []
                inner, outer = set(inner or ()), set(outer or ())
                wanted = inner if any(k in inner for k, _ in slots) else outer
                texts.append(" ".join(t for k, t in slots if k in wanted))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["key", "url", "text"])

    return joined.mapInArrow(run, schema).withColumnRenamed("key", key)


def digest(pages: DataFrame) -> DataFrame:
    return extracted(pages).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
