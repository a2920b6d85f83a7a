"""Reading HTML into elements, and their text into blocks: the part of main-text extraction that sees one page."""

from __future__ import annotations

import html
import re
from array import array

import xxhash

#: Fixed sets of HTML's own element names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody tfoot thead tr ul".split()
)
#: What a start tag closes, as far up as the first element of the second set.
CLOSES = (
    {name: (frozenset({"p"}), frozenset({"button", "td", "th", "table", "object", "caption"})) for name in BLOCK - {"body", "html", "caption", "legend", "optgroup", "option", "tbody", "tfoot", "thead", "tr", "li", "dd", "dt"}}
    | {"li": (frozenset({"li", "p"}), frozenset({"ul", "ol", "menu", "dir", "table"}))}
    | {name: (frozenset({"dt", "dd", "p"}), frozenset({"dl", "table"})) for name in ("dt", "dd")}
    | {name: (frozenset({"td", "th", "p"}), frozenset({"table", "tr"})) for name in ("td", "th")}
    | {"tr": (frozenset({"tr", "td", "th", "p"}), frozenset({"table"})), "option": (frozenset({"option"}), frozenset({"select", "datalist"}))}
    | {name: (frozenset({"tbody", "thead", "tfoot", "tr", "td", "th", "p", "caption", "colgroup"}), frozenset({"table"})) for name in ("tbody", "thead", "tfoot")}
)
#: Elements whose end tag doesn't reach out of a table cell or a list they stand in.
SCOPES = frozenset({"table", "td", "th", "caption", "button", "object"})
WALLS = SCOPES | BLOCK
TABLE = frozenset("table caption tbody thead tfoot tr td th".split())

#: Elements that aren't part of any article's text.
NEVER = frozenset("head script style template noscript iframe object embed applet canvas svg audio video nav menu footer aside dialog button input select textarea datalist label fieldset optgroup option noembed noframes search".split())
#: Elements that hold a page's main text.
MAIN = frozenset({"article", "main"})
ROLES_MAIN = frozenset({"main", "article"})
ROLES_NEVER = frozenset("navigation banner contentinfo complementary search dialog alertdialog menu menubar toolbar form alert tablist".split())
#: Words of class and id attributes that name what isn't the main text.
WORDS_NEVER = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promos promoted promotion banner banners cookie cookies consent gdpr notice notices alert alerts popup popups modal overlay newsletter subscribe subscription signup signin login paywall sidebar sidebars widget widgets related recommended recommendations trending popular share sharing social comment comments disqus replies respond breadcrumb breadcrumbs menu menus nav navbar navigation pagination pager footer foot topbar toolbar search skip taboola outbrain teaser teasers copyright colophon".split()
)
#: The same, but only outside the main text: an article's own head is a part of it.
WORDS_OUTSIDE = frozenset("header head masthead".split())
#: Words at the end of a name that say nothing of what it names, and words after which it speaks of something else.
WORDS_IDLE = frozenset("container wrapper wrap inner outer box bar block blocks left right top bottom list section area item items row col column group panel unit slot slots link links text form buttons posts articles stories news x".split())
WORDS_TURN = frozenset("no not with without has".split())
#: Elements that can be a site's template by themselves; paragraphs, headings and the like only go with one.
CONTAINERS = frozenset("div section header footer nav aside ul ol dl table form center address details fieldset menu dir".split())
#: Elements nested deeper than this are siblings: their text stays.
DEEPEST = 2000

_ATTRIBUTES = re.compile(r"""(?:[\s/]++|[^\s/>=]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?+)?+|=)*+>""")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
_SAYS = re.compile(r"""([^\s/>=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]++)))?+""")
_TELLING = re.compile(r"\b(?:class|id|role|itemprop|hidden)\b", re.I)
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
#: Kinds of an element: plain, main text, never main text, not outside the main text, a form.
PLAIN, IS_MAIN, IS_NEVER, OUTSIDE, IS_FORM = range(5)

_kinds: dict[tuple[str, str], int] = {}


def _kind(name: str, attributes: str) -> int:
    """What an element is by its name and attributes. What is kept is bounded."""
    said = attributes if attributes and _TELLING.search(attributes) else ""
    key = (name, said)
    if (found := _kinds.get(key)) is None:
        found = _kind_of(name, said)
        if len(said) < 200:
            if len(_kinds) > 20_000:
                _kinds.clear()
            _kinds[key] = found
    return found


def _named(words: list[str]) -> str:
    """The word of a class or id that says what it names: mostly the last, as in "post-comments" or "cookie-notice-box"."""
    for i, w in enumerate(words):
        if w in WORDS_TURN:
            words = words[:i]
            break
    last = len(words)
    while last > 1 and (words[last - 1] in WORDS_IDLE or words[last - 1].isdigit()):
        last -= 1
    return words[last - 1] if last else ""


def _kind_of(name: str, attributes: str) -> int:
    if name in NEVER:
        return IS_NEVER
    if name in ("html", "body"):
        return PLAIN
    roles: set[str] = set()
    named: set[str] = set()
    for m in _SAYS.finditer(attributes):
        what = m[1].lower()
        value = html.unescape(m[2] or m[3] or m[4] or "")
        if what == "hidden":
            return IS_NEVER
        if what == "role":
            roles |= set(value.lower().split())
        elif what == "itemprop" and "articlebody" in value.lower():
            roles.add("main")
        elif what in ("class", "id"):
            named |= {_named([x.lower() for x in _PARTS.findall(word)]) for word in value.split()}
    if roles & ROLES_NEVER or named & WORDS_NEVER:
        return IS_NEVER
    if name in MAIN or roles & ROLES_MAIN:
        return IS_MAIN
    if name == "form":
        return IS_FORM
    return OUTSIDE if name == "header" or named & WORDS_OUTSIDE else PLAIN


class Page:
    """The elements of a page in order, each with its parent, its kind, its end, and the pieces of text between them.

    Start tags close what HTML lets them close (a paragraph ends where the next one begins); end tags that fit nothing
    are skipped; what is open at the end ends there. Nothing recurses, so depth doesn't matter, and a page takes time
    in proportion to its length.
    """

    def __init__(self, source: str) -> None:
        self.names = ["html"]
        self.kinds = [PLAIN]
        self.parents = array("l", [-1])
        self.ends = array("l", [0])  # the element after an element's last descendant
        self.pieces: list[tuple[int, str]] = []  # (element, text); a block boundary within has no piece of its own
        self.at = array("l")  # how many elements had begun before each piece
        self._read(source)

    def _read(self, s: str) -> None:
        names, kinds, parents, ends, pieces = self.names, self.kinds, self.parents, self.ends, self.pieces
        stack = [0]
        open_: dict[str, int] = {}  # how many open elements have a name
        n, pos = len(s), 0

        def text(piece: str) -> None:
            if piece:
                pieces.append((stack[-1], html.unescape(piece) if "&" in piece else piece))
                self.at.append(len(names))

        def close(depth: int) -> None:
            for e in stack[depth:]:
                ends[e] = len(names)
                open_[names[e]] -= 1
            del stack[depth:]

        while pos < n:
            lt = s.find("<", pos)
            while lt >= 0 and not (lt + 1 < n and (s[lt + 1].isascii() and s[lt + 1].isalpha() or s[lt + 1] in "/!?")):
                lt = s.find("<", lt + 1)
            if lt < 0:
                text(s[pos:])
                break
            text(s[pos:lt])
            c = s[lt + 1]
            if c in "!?":
                if s.startswith("<!--", lt):
                    end = lt + 4 if s.startswith("<!-->", lt) else lt + 5 if s.startswith("<!--->", lt) else s.find("-->", lt + 4) + 3
                    if end == 2:
                        break  # an open comment takes the rest of the page
                    pos = end if s[end - 1] == ">" else end + 1
                else:
                    end = s.find(">", lt)
                    pos = n if end < 0 else end + 1
                continue
            is_end = c == "/"
            m = _NAME.match(s, lt + 1 + is_end)
            if m is None:  # "</" and no name is a comment up to ">"
                end = s.find(">", lt)
                pos = n if end < 0 else end + 1
                continue
            rest = _ATTRIBUTES.match(s, m.end())
            if rest is None:  # the page ends within the tag
                break
            pos = rest.end()
            name = m[0].lower()
            if is_end:
                if open_.get(name):
                    depth = len(stack) - 1
                    walls = () if name in TABLE or name in BLOCK and name not in ("p", "li", "dd", "dt") else SCOPES if name in BLOCK else WALLS
                    while names[stack[depth]] != name and names[stack[depth]] not in walls:
                        depth -= 1
                    if depth and names[stack[depth]] == name:
                        close(depth)
                elif name == "br":
                    text(" ")
                continue
            if name == "br":
                text(" ")
                continue
            if name in ("html", "body") and len(names) > 1 and (name == "html" or open_.get("body")):
                continue
            if (closing := CLOSES.get(name)) is not None and any(map(open_.get, closing[0])):
                shut, until = closing
                depth = len(stack) - 1
                lowest = None
                # elements between that aren't closed by themselves, such as an open <b>, end with what is closed
                while depth > 0 and names[stack[depth]] not in until:
                    inner = names[stack[depth]]
                    if inner in shut:
                        lowest = depth
                    elif inner in BLOCK and name not in TABLE and not (inner in ("div", "address") and name in ("li", "dd", "dt")):
                        break
                    depth -= 1
                if lowest is not None:
                    close(lowest)
            e = len(names)
            names.append(name)
            kinds.append(_kind(name, s[m.end() : pos - 1]))
            parents.append(stack[-1])
            ends.append(e + 1)
            if name in VOID or len(stack) > DEEPEST:
                continue
            if name in RAW:
                end = self._raw_end(s, name, pos)
                if name not in NEVER and name != "title" and end > pos:
                    stack.append(e)
                    text(s[pos:end])
                    stack.pop()
                pos = s.find(">", end) + 1 if end < n else n
                if not pos:
                    pos = n
                continue
            stack.append(e)
            open_[name] = open_.get(name, 0) + 1
        close(1)
        ends[0] = len(names)

    @staticmethod
    def _raw_end(s: str, name: str, pos: int) -> int:
        at = pos
        while (at := s.find("</", at)) >= 0:
            if s[at + 2 : at + 2 + len(name)].lower() == name and s[at + 2 + len(name) : at + 3 + len(name)] in (" ", ">", "/", "\t", "\n", "\r", "\f", ""):
                return at
            at += 2
        return len(s)

    def hashes(self) -> list[int]:
        """64 bits of each element's subtree: its name, and its texts and elements in order; attributes don't count. 0: no text in it."""
        out = [0] * len(self.names)
        inside: list[list[bytes]] = [[name.encode()] for name in self.names]
        some = bytearray(len(self.names))
        piece = len(self.pieces) - 1
        # from the last element back, so children are whole before their parents; parts are gathered last first
        for e in range(len(self.names) - 1, -1, -1):
            while piece >= 0 and self.at[piece] > e:
                owner, text = self.pieces[piece]
                if t := " ".join(text.split()):
                    inside[owner].append(t.encode("utf-8", "surrogatepass"))
                    some[owner] = 1
                piece -= 1
            h = xxhash.xxh3_64_intdigest(b"\0".join(inside[e]))
            p = self.parents[e]
            if some[e]:
                out[e] = h
                if p >= 0:
                    some[p] = 1
            if p >= 0:
                inside[p].append(b"\1" + h.to_bytes(8, "little"))
            inside[e] = []
        return out

    def removed(self) -> bytearray:
        """Which elements aren't main text by name, role or class; they and all in them go.

        Main text is what the outermost article and main elements hold, or the whole page, without lists of links, where there
        are none. A form that wraps main text is none.
        """
        names, kinds, parents = self.names, self.kinds, self.parents
        n = len(names)
        holds = bytearray(n)  # a main element that isn't in something removed lies within
        gone = bytearray(n)
        for e in range(1, n):
            if gone[parents[e]] or kinds[e] == IS_NEVER:
                gone[e] = 1
            elif kinds[e] == IS_MAIN:
                up = e
                while up >= 0 and not holds[up]:
                    holds[up] = 1
                    up = parents[up]
        in_main = bytearray(n)
        any_main = holds[0]
        letters = None
        for e in range(n):
            p = parents[e]
            in_main[e] = kinds[e] == IS_MAIN or (p >= 0 and in_main[p])
            if p >= 0 and gone[p]:
                gone[e] = 1
            elif kinds[e] == OUTSIDE and not in_main[e] and not holds[e]:
                gone[e] = 1
            elif kinds[e] == IS_FORM and not holds[e]:
                if letters is None:
                    letters = self.letters()
                gone[e] = in_main[e] or 2 * letters[e] < letters[0]
        self.in_main, self.any_main, self.holds = in_main, any_main, holds
        if not any_main:
            self._without_menus(gone)
        return gone

    def _without_menus(self, gone: bytearray) -> None:
        """Where no element is named as main text: lists and the like of which four fifths are several links, but less than half of the page."""
        letters, links = self.letters(), [int(name == "a") for name in self.names]
        for e in range(len(links) - 1, 0, -1):
            links[self.parents[e]] += links[e]
        if links[0] < 2:
            return
        linked = self.letters(linked=True)
        for e in range(1, len(links)):
            if gone[self.parents[e]] or self.names[e] in CONTAINERS and links[e] > 1 and 0 < 4 * letters[e] <= 5 * linked[e] and 2 * letters[e] < letters[0]:
                gone[e] = 1

    def letters(self, linked: bool = False) -> list[int]:
        """Characters of text in each element's subtree; linked: those in links only."""
        out = [0] * len(self.names)
        in_link = bytearray(len(self.names))
        if linked:
            for e in range(1, len(self.names)):
                in_link[e] = self.names[e] == "a" or in_link[self.parents[e]]
        for owner, text in self.pieces:
            if not linked or in_link[owner]:
                out[owner] += len("".join(text.split()))
        for e in range(len(self.names) - 1, 0, -1):
            out[self.parents[e]] += out[e]
        return out

    def blocks(self, gone: bytearray) -> list[str]:
        """Blocks of the text that is left, in order: white space within one is a single space."""
        out: list[str] = []
        parts: list[str] = []

        def end() -> None:
            if parts:
                if block := " ".join("".join(parts).split()):
                    out.append(block)
                parts.clear()

        names, parents = self.names, self.parents
        around = [0] * len(names)  # the nearest block that an element is or stands in
        for e in range(1, len(names)):
            around[e] = e if names[e] in BLOCK else around[parents[e]]
        last, seen = -1, 1
        for i, (owner, text) in enumerate(self.pieces):
            began = self.at[i]
            between = names[seen:began]  # elements that began since the last piece
            if around[owner] != last or not BLOCK.isdisjoint(between):
                end()
                last = around[owner]
            elif "td" in between or "th" in between:
                parts.append(" ")
            seen = began
            if not gone[owner] and (not self.any_main or self.in_main[owner]):
                parts.append(text)
        end()
        return out
