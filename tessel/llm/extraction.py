"""Main text of web pages by equivalence-class template deduction.

Tokens of a page are its tags and text pieces, told apart by their place in
the tree. Tokens of one host whose occurrence vectors over the host's pages
are equal form an equivalence class; vectors are compared by a fingerprint
that is summed by exclusive or, so classes come from grouped aggregation, not
from gathering a host's pages. Classes that are large and frequent enough are
read along all pages again: valid ones keep one order in every page and nest,
each always in one place of another; members out of order leave their class,
and of two classes that cross or nest in several places the lesser goes. By
the valid ones, other tokens are then told apart by the class and place that
they stand in, vectors are counted anew, and so on until no token is told
apart further. The valid class that occurs once a page, on most pages, is the
outer template, and the text between two of its neighbours is a slot. The
others nest in it: they repeat inside a slot or stand on some of the pages,
each with its own tags and text. A block of which all text is of
valid classes is the template's own, such as a notice line in every article,
and is no article wherever it stands, unless such blocks are most of a page's
article, as where a host repeats whole articles. The article is in the slots with text of an article
container where the page has one, and else in the slots whose text is not the
template's own, whatever their length; those of mostly links only between
others. Boxes inside them that are no article (adverts, notices, forms,
comments, scripts and the like) are left out wherever they stand.

Edge cases: a null or empty html, or one without text, gives an empty text;
unclosed and crossing tags, stray marks and unknown references are taken as
browsers take them; a null url is a host of its own; a host with few pages has
no template, and its pages are cut by their tags alone; repeated rows give
equal texts; an empty table gives an empty result; other columns pass through,
but for ``text`` and ``html``.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mix, prepare, sized_join, stored

#: A class is valid with this many tokens, in this share of a host's pages, of this many pages.
CLASS_TOKENS, SUPPORT, LEAST_PAGES = 3, 0.6, 4

def _token(attr: str) -> re.Pattern:
    return re.compile(
        rf"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|noscript|template|textarea|title|iframe|svg|math)\b(?P<rawattr>{attr})>(?P<rest>.*?)(?:</(?P=raw)\s*>|\Z)"
        rf"|<(?P<close>/?)(?P<tag>[a-z][^\s/>]*)(?P<attr>{attr})>|<[!?][^>]*>|[^<]+|<",
        re.S | re.I,
    )


#: Markup and text of a page; and of one with a quotation mark that never ends, where the next > ends a tag.
_TOKEN, _PLAIN = _token(r"(?:[^>\"']|\"[^\"]*\"|'[^']*')*"), _token("[^>]*")


def _marks(source: str) -> Iterator[re.Match]:
    """Tokens in page order, in time linear in the page: a tag that does not end is looked for once."""
    last = source.rfind(">")
    for m in _TOKEN.finditer(source):
        if m.end() - m.start() == 1 and m[0] == "<" and source[m.end() : m.end() + 1] in _OPENS and m.end() < len(source):
            yield from _PLAIN.finditer(source, m.start(), last + 1)
            if last + 1 < len(source):
                rest = max(m.start(), last + 1)
                yield from re.compile(r"[^<]+|<").finditer(source, rest)
            return
        yield m


_OPENS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ/!?")
_ATTR = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)

#: Fixed values of HTML: elements that are no boxes of text, that break text into blocks, and that have no end.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_CONTAINER = frozenset("article aside body div footer form header main nav section table td".split())
_OUT = frozenset("nav aside footer form button select option label dialog menu head".split())
_OUT_ROLE = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
_OUT_NAME = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|cookies?|consent|gdpr|notice|popup|modal|overlay|newsletter|subscribe|subscription|signup|sidebar|side|widget|comments?|commentlist|replies|reply|respond|disqus|discussion|share|sharing|social|related|recommend\w*|breadcrumbs?|menu|nav|navbar|navigation|footer|header|masthead|toolbar|pagination|pager|login)(?:$|[\s_-])",
    re.I,
)


@dataclass
class Piece:
    """A text piece with where it stands."""

    place: int
    text: str
    block: int
    out: bool
    link: bool
    article: bool
    box: int


@dataclass
class Page:
    tokens: list[int] = field(default_factory=list)
    pieces: list[Piece] = field(default_factory=list)
    borders: set[int] = field(default_factory=set)


def _hash(x: str, text: bool = False) -> int:
    """63 bits of a token; the lowest says that it is text."""
    return (xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass")) >> 2) << 1 | text


def parse(source: str) -> Page:
    """Tokens, as hashes of their kind and path, and text pieces of a page."""
    page = Page()
    # an open element: name, path hash, left out, link, in an article, path hash of the box it is in
    stack: list[tuple[str, int, bool, bool, bool, int]] = [("", 0, False, False, False, 0)]
    block = 0
    for m in _marks(source):
        kind = m.lastgroup
        if kind in ("rest", "rawattr", "raw"):
            page.tokens.append(_hash(f"{stack[-1][1]}<{m['raw'].lower()}>"))
            continue
        if not m.re.groups or m["tag"] is None:
            text = m[0]
            if text.startswith("<!--") or (text[0] == "<" and len(text) > 1):
                continue
            top = stack[-1]
            shown = entities.unescape(text)
            if shown.strip():
                page.tokens.append(_hash(f"{top[1]}#{' '.join(shown.split())}", True))
            page.pieces.append(Piece(len(page.tokens), shown, block, *top[2:]))
            continue
        name = m["tag"].lower()
        if name in _BLOCK:
            block += 1
        if m["close"]:
            at = next((k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == name), 0)
            if at:
                page.tokens.append(_hash(f"{stack[at][1]}</{name}>"))
                if name in _CONTAINER:
                    page.borders.add(page.tokens[-1])
                del stack[at:]
            continue
        if name == "br" and page.pieces:
            page.pieces.append(Piece(len(page.tokens), " ", block, *stack[-1][2:]))
        if name in ("p", "li", "tr", "td", "th", "dd", "dt", "option"):  # these end their own kind
            _end_open(stack, name)
        top = stack[-1]
        attrs = {a.lower(): (v or "").strip("\"'") for a, v in _ATTR.findall(m["attr"])} if m["attr"] else {}
        names = f"{attrs.get('class', '')} {attrs.get('id', '')}".strip()
        role = attrs.get("role", "").lower()
        path = _hash(f"{top[1]}/{name}.{names}")
        page.tokens.append(_hash(f"{path}<{name}>"))
        if name in _CONTAINER:
            page.borders.add(page.tokens[-1])
        if name in _VOID or m["attr"].endswith("/"):
            continue
        whole = name in ("html", "body", "article", "main")
        out = top[2] or name in _OUT or role in _OUT_ROLE or "hidden" in attrs or attrs.get("aria-hidden") == "true" or (not whole and bool(names) and bool(_OUT_NAME.search(names))) or (name == "header" and not top[4])
        stack.append((name, path, out, top[3] or name == "a", top[4] or name in ("article", "main") or role in ("main", "article"), path if name in _CONTAINER else top[5]))
    return page


def _end_open(stack: list[tuple], name: str) -> None:
    """An open element of the same kind ends, unless a container was opened in it since."""
    for k in range(len(stack) - 1, 0, -1):
        if stack[k][0] == name:
            del stack[k:]
            return
        if stack[k][0] in _BLOCK and stack[k][0] != "p":
            return


def blocks(pieces: list[Piece]) -> str:
    """Pieces joined by block, white space as one space, blocks by one line feed."""
    out: list[str] = []
    held: list[str] = []
    last = None
    for p in pieces:
        if p.block != last:
            out.append(" ".join("".join(held).split()))
            held, last = [], p.block
        held.append(p.text)
    out.append(" ".join("".join(held).split()))
    return "\n".join(x for x in out if x)


def slots(page: Page, roles: list[int], outer: list[int]) -> list[int]:
    """For each piece, the number of the outer template's box borders before it; 0 for all where the page does not follow the order.

    Tokens of headings, paragraphs and the like nest inside a slot and do not part it.
    """
    place = {r: k for k, (r, t) in enumerate(zip(roles, page.tokens, strict=True)) if t in page.borders}
    known = [place[r] for r in outer if r in place]
    if not known or any(a > b for a, b in zip(known, known[1:], strict=False)):
        return [0] * len(page.pieces)
    return np.searchsorted(np.array(known), [p.place - 1 for p in page.pieces], side="left").tolist()


def own_text(roles: list[int], pieces: list[Piece], words: frozenset[int]) -> list[Piece]:
    """``pieces`` without blocks that are the template's own text throughout, unless those are most of it."""
    size = lambda ps: sum(len(p.text.strip()) for p in ps)
    varied = {p.block for p in pieces if p.text.strip() and roles[p.place - 1] not in words}
    left = [p for p in pieces if p.block in varied]
    return left if 2 * size(left) >= size(pieces) else pieces


def main_text(source: str | None, template: Template | None = None) -> str:
    """The text of the page's main slots without the boxes that are no article and without the template's own words."""
    if not source:
        return ""
    page = parse(source)
    template = template or Template()
    roles, outer, words = template.roles(page.tokens), template.outer, template.words
    kept = [p for p in page.pieces if not p.out]
    if any(p.article and p.text.strip() for p in kept):
        return blocks(own_text(roles, [p for p in kept if p.article], words))
    slot = dict(zip(map(id, page.pieces), slots(page, roles, outer), strict=True))
    size, links = Counter(), Counter()
    for p in kept:
        n = len(p.text.strip())
        size[slot[id(p)]] += n
        links[slot[id(p)]] += n * p.link
    constant = words.union(outer)
    varied = {slot[id(p)] for p in kept if p.text.strip() and roles[p.place - 1] not in constant} or {k for k, v in size.items() if v}
    main = {k for k in varied if 2 * links[k] < size[k]}
    if not main:
        return ""
    main |= {k for k in varied if min(main) < k < max(main)}
    boxes = {p.box for p in kept if slot[id(p)] in main and p.text.strip() and not p.link}
    return blocks(own_text(roles, [p for p in kept if slot[id(p)] in main or p.box in boxes], words))


class Classes:
    """Classes of a host, best first, as lists of roles in page order; read along pages."""

    def __init__(self, members: list[list[int]]):
        self.members = members
        self.of = {r: (c, j) for c, rs in enumerate(members) for j, r in enumerate(rs)}
        self.last = [len(rs) - 1 for rs in members]
        self.names: dict[tuple[int, int, int], int] = {}

    def follow(self, roles: list[int]) -> tuple[list[int], set[tuple[int, int, int]], tuple[int, int] | None]:
        """Roles told apart by where they stand in the innermost class, where each class stands in another, and two classes that cross.

        A role's new name is of the old one, the class and the place in it; members keep theirs.
        """
        of, names, last = self.of, self.names, self.last
        if len(names) > 200_000:
            names.clear()
        out, nests, stack, opened = roles.copy(), set(), [], set()
        for k, r in enumerate(roles):
            member = of.get(r)
            if member is None:
                if stack:
                    c, j = stack[-1]
                    name = names.get((r, c, j))
                    if name is None:
                        name = names[r, c, j] = ((xxhash.xxh3_64_intdigest(f"{r}@{self.members[c][0]}.{j}") >> 3) << 1 | r & 1) - (1 << 63)
                    out[k] = name
                continue
            c, j = member
            if j == 0 and c not in opened:
                nests.add((c, *(stack[-1] if stack else (-1, 0))))
                stack.append((c, 0))
                opened.add(c)
            elif j and stack and stack[-1] == (c, j - 1):
                stack.pop()
                if j < last[c]:
                    stack.append((c, j))
                else:
                    opened.discard(c)
            else:
                return out, nests, (c, stack[-1][0] if stack else c)
        return out, nests, (stack[-1][0], stack[-1][0]) if stack else None

    def unordered(self, roles: list[int]) -> list[tuple[int, int, int, bool]]:
        """(class, member, last member up to which the class keeps its order from there, whether the member is out of order) of classes that do not."""
        at: dict[int, list[list[int]]] = {}
        for k, r in enumerate(roles):
            if r in self.of:
                c, j = self.of[r]
                at.setdefault(c, [[] for _ in self.members[c]])[j].append(k)
        out = []
        for c, places in at.items():
            if len({len(x) for x in places}) > 1:
                out += [(c, a, a, True) for a in range(len(places))]
                continue
            p = np.array(places)  # member, time
            after = np.append(np.minimum.accumulate(p[::-1], 0)[:0:-1], np.full((1, p.shape[1]), 1 << 60), 0)
            before = np.append(np.full((1, p.shape[1]), -1), np.maximum.accumulate(p, 0)[:-1], 0)
            stray = (p > after).any(1) | (p < before).any(1)
            stray |= (p[:, :-1] > p.min(0)[1:]).any(1) | (p[:, 1:] < p.max(0)[:-1]).any(1)
            if not stray.any():
                continue
            for a in range(len(p)):
                b = a
                while b + 1 < len(p) and (p[b] < p[b + 1]).all() and (p[b + 1, :-1] < p[a, 1:]).all():
                    b += 1
                out.append((c, a, b, bool(stray[a])))
        return out


class Template:
    """A host's template as `_next` writes it: classes that told roles apart, round by round, and the valid classes of the last."""

    def __init__(self, state: str | None = None):
        self.state = json.loads(state) if state else {"rounds": [], "classes": []}
        self.rounds = [Classes(x) for x in self.state["rounds"]]
        self.classes = Classes([x[2] for x in self.state["classes"] or []])
        self.outer = next((rs for pages, n, rs in self.state["classes"] or [] if n == pages), [])
        self.words = frozenset(r for rs in self.classes.members for r in rs if r & 1)

    def roles(self, tokens: list[int]) -> list[int]:
        for classes in self.rounds:
            tokens = classes.follow(tokens)[0]
        return tokens


class Known(dict):
    """Templates by their written form, kept for those seen lately."""

    def __missing__(self, state: str | None) -> Template:
        if len(self) >= 256:
            self.clear()
        got = self[state] = Template(state)
        return got


TOKENS = "host string, page_print long, tokens array<long>"


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tokens = [parse(x or "").tokens for x in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(tokens, pa.list_(pa.int64()))], ["host", "page_print", "tokens"])


#: What is found along pages: occurrence vectors of roles, classes out of order, classes that cross, and where classes nest.
ROLE, ORDER, CROSS, NEST = range(4)
_FOUND = [("host", pa.string()), ("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("print", pa.int64()), ("pages", pa.int64()), ("n", pa.int64()), ("first", pa.float64()), ("reach", pa.int64())]
FOUND = "host string, kind int, a long, b long, print long, pages long, n long, first double, reach long"


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per batch: of each role told apart by the classes, the fingerprint of its occurrence vector, pages, occurrences and mean place; and what is wrong with the classes.

    The role -1 stands for the page itself; its occurrences are the page's different roles.
    """
    known = Known()
    for batch in batches:
        held: dict[tuple[str, int, int, int], list] = {}
        for host, page_print, tokens, state in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            template = known[state]
            before = template.roles(tokens)
            roles, nests, crossed = template.classes.follow(before)
            for c, parent, j in nests:
                held.setdefault((host, NEST, c, parent << 32 | j), [0, 0, 0, 0.0, 0])
            if crossed:
                unordered = template.classes.unordered(before)
                for c, a, b, stray in unordered:
                    got = held.setdefault((host, ORDER, c, a), [0, 0, 0, 0.0, b])
                    got[1] += stray
                    got[4] = min(got[4], b)
                if not unordered:
                    held.setdefault((host, CROSS, *crossed), [0, 0, 0, 0.0, 0])
                continue  # the host is read again with other classes
            first = {r: k for k, r in zip(range(len(roles) - 1, -1, -1), reversed(roles), strict=True)}
            count = Counter(roles)
            different = len(count)
            count[-1], first[-1] = 1, -1
            seen = np.fromiter(count.values(), np.uint64, len(count))
            prints = mix(mix(np.full(len(count), page_print, np.int64).view(np.uint64)) + seen).view(np.int64).tolist()
            for (r, n), p in zip(count.items(), prints, strict=True):
                got = held.get((host, ROLE, r, 0))
                if got is None:
                    got = held[host, ROLE, r, 0] = [0, 0, 0, 0.0, 0]
                got[0] ^= p
                got[1] += 1
                got[2] += different if r == -1 else n
                got[3] += first[r]
        rows = [(*k, *v) for k, v in held.items()]
        cols = list(zip(*rows, strict=True)) or [()] * len(_FOUND)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(cols, _FOUND, strict=True)], [x for x, _ in _FOUND])


def mended(classes: list[list], wrong: list[dict]) -> list[list]:
    """Classes of members that keep their order on all pages, without the lesser of two that cross or nest in several places.

    Members that are out of order somewhere leave their class, in runs that keep an order of their own.
    """
    order: dict[int, dict[int, tuple[int, bool]]] = {}
    nests: dict[int, set[int]] = {}
    gone: set[int] = set()
    for w in wrong:
        if w["kind"] == ORDER:
            order.setdefault(w["a"], {})[w["b"]] = (w["reach"], w["pages"] > 0)
        elif w["kind"] == CROSS:
            gone.add(max(w["a"], w["b"]))
        else:
            nests.setdefault(w["a"], set()).add(w["b"])
    for c, places in nests.items():
        if len(places) > 1:
            gone.add(max(c, *(x >> 32 for x in places)))
    out = []
    for c, (pages, n, members) in enumerate(classes):
        if c in gone:
            continue
        reach = order.get(c, {})
        stray = [a for a in range(len(members)) if a in reach and reach[a][1]]
        runs = [sorted(set(range(len(members))).difference(stray))]
        while stray:
            runs.append([a for a in stray if a <= reach[stray[0]][0]])
            stray = stray[len(runs[-1]) :]
        out += [[pages, n, [members[a] for a in run]] for run in runs if len(run) >= CLASS_TOKENS]
    return out


def ranked(classes: list[dict]) -> list[list]:
    """Classes that occur once a page first, then those of most pages and members."""
    order = sorted(classes, key=lambda c: (c["n"] != c["pages"], -c["pages"], -len(c["members"]), c["members"][0]["at"]))
    return [[c["pages"], c["n"], [m["a"] for m in c["members"]]] for c in order]


def _next(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, state, done) of hosts after their pages were read with the classes of a state.

    Classes with something wrong are mended and read again. Valid ones tell
    roles apart, and classes are made anew, until no role is told apart further.
    """
    for batch in batches:
        rows = []
        for host, state, wrong, classes, different, often in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            now = json.loads(state) if state else {"rounds": [], "classes": None, "seen": None}
            found, seen = ranked(json.loads(classes or "[]")), [different, often]
            had = now["classes"]
            done = False
            if had is None:
                now |= {"classes": found, "seen": seen}
            elif (better := mended(had, json.loads(wrong or "[]"))) != had:
                now["classes"] = better
            elif seen == now["seen"] or sorted(x[2] for x in had) == sorted(x[2] for x in found):
                done = True
            else:
                now |= {"rounds": [*now["rounds"], [x[2] for x in had]], "classes": found, "seen": seen}
            rows.append((host, json.dumps(now), done or not now["classes"]))
        cols = list(zip(*rows, strict=True)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.bool_()), strict=True)], ["host", "state", "done"])


def host_of(url: str = "url"):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1)), F.lit(""))


def templates(pages: DataFrame) -> DataFrame:
    """(host, outer, state): the tokens of each host's outer template that their path alone tells apart, in page order, and the whole template. Stored.

    A class is a set of roles with one fingerprint. All pages are read with the
    classes found: those that do not keep one order, cross others or nest in
    several places are cut or dropped; by the valid ones, roles are told apart
    by the class and place that they stand in, which gives further classes, and
    so on until nothing changes. The outer template is the valid class of most
    pages that occurs once in each; the others are nested in it.
    """
    # rows that repeat are told apart, since their fingerprints would cancel out
    named = pages.select(host_of().alias("host"), F.xxhash64("page_id", "url", "html", F.monotonically_increasing_id()).alias("page_print"), "html")
    tokens = stored(named.mapInArrow(_tokens, TOKENS))
    read, ended = tokens.withColumn("state", F.lit(None).cast("string")), []
    states = None
    while True:
        sums = [F.bit_xor("print").alias("print"), *[F.sum(c).alias(c) for c in ("pages", "n", "first")], F.min("reach").alias("reach")]
        found = stored(read.mapInArrow(_counted, FOUND).groupBy("host", "kind", "a", "b").agg(*sums).where((F.col("kind") > ROLE) | (F.col("pages") >= 2)))
        roles = found.where(F.col("kind") == ROLE)
        whole = roles.where("a = -1").select("host", F.col("pages").alias("all_pages"))
        members = roles.where("a <> -1").join(whole, "host").where((F.col("all_pages") >= LEAST_PAGES) & (F.col("pages") >= SUPPORT * F.col("all_pages")))
        classes = members.groupBy("host", "print", "pages", "n").agg(F.array_sort(F.collect_list(F.struct((F.col("first") / F.col("pages")).alias("at"), "a"))).alias("members"))
        classes = classes.where(F.size("members") >= CLASS_TOKENS).groupBy("host").agg(F.to_json(F.collect_list(F.struct("pages", "n", "members"))).alias("classes"))
        wrong = found.where(F.col("kind") > ROLE).groupBy("host").agg(F.to_json(F.collect_list(F.struct("kind", "a", "b", "pages", "reach"))).alias("wrong"))
        seen = roles.groupBy("host").agg(F.sum(F.when(F.col("a") == -1, F.col("n"))).alias("different"), F.count("*").alias("often"))
        had = classes.select("host", F.lit(None).cast("string").alias("state")) if states is None else states
        had = had.join(wrong, "host", "left").join(classes, "host", "left").join(seen, "host", "left")
        states = stored(had.select("host", "state", "wrong", "classes", "different", "often").mapInArrow(_next, "host string, state string, done boolean"))
        ended.append(states.where("done").select("host", "state"))
        states = states.where("not done").select("host", "state")
        if states.isEmpty():
            break
        states = stored(states)
        read = sized_join(tokens, states, "host", ["page_print"]).where(F.col("state").isNotNull()).select("host", "page_print", "tokens", "state")
    out = ended[0]
    for more in ended[1:]:
        out = out.union(more)
    known = Known()
    by_path = F.udf(lambda state: [r for r in known[state].outer if r >= 0], T.ArrayType(T.LongType()))
    return stored(out.select("host", by_path("state").alias("outer"), "state"))


def extract(pages: DataFrame) -> DataFrame:
    """``pages`` with ``text``, the main text, in place of ``html``."""
    prepare(pages.sparkSession)
    kept = [c for c in pages.columns if c not in ("html", "text")]
    schema = pages.select(*[F.col(f"`{c}`") for c in kept]).schema.add("text", T.StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, known = len(kept), Known()
        for batch in batches:
            texts = [main_text(s, known[t]) for s, t in zip(*(batch.column(n + k).to_pylist() for k in range(2)), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(texts, pa.string())], [*kept, "text"])

    named = pages.select(*[F.col(f"`{c}`") for c in kept], F.col("html").alias("__html"), host_of().alias("__host"))
    known = templates(pages).select(F.col("host").alias("__host"), F.col("state").alias("__state"))
    joined = sized_join(named, known, "__host", ["__html"])
    return joined.select(*[F.col(f"`{c}`") for c in kept], "__html", "__state").mapInArrow(run, schema)
