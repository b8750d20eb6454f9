"""From HTML, Markdown, wiki and LaTeX markup to blocks of text.

``parse`` reads one text, in whatever mixture of the four, into blocks (tag, text) and counts the
pieces of markup it met. Tags are h1 to h6, p, li, tr, pre, math and quote; an item's tag also has its
depth and, in a numbered list, its number (li2, li1n3), that of code its language (pre-python);
``kind`` is the tag without these. ``render`` writes
blocks as clean text in which headings, lists, code, formulas, tables and quotations can still be
told apart. Signs used as plain characters (comparisons, money, paths, identifiers, note numbers,
names of languages) are left alone and not counted.
"""

from __future__ import annotations

import html
import re

from .oneform import INVISIBLE

Block = tuple[str, str]

# The elements of HTML and of wiki extensions.
ELEMENTS = frozenset(
    "a abbr acronym address area article aside audio b base bdi bdo big blockquote body br button canvas caption "
    "center cite code col colgroup dd del details dfn div dl dt em embed fieldset figcaption figure font footer form "
    "frame frameset gallery h1 h2 h3 h4 h5 h6 head header hr html i iframe img imagemap includeonly input ins kbd "
    "label legend li link main map mark math menu meta nav noinclude nobr nowiki noscript object ol onlyinclude "
    "optgroup option p param poem pre q ref references rp rt ruby s samp score script section select small source "
    "span strike strong style sub summary sup svg syntaxhighlight table tbody td template templatedata textarea tfoot "
    "th thead time timeline title tr track tt u ul var video wbr".split()
)
_APART = frozenset(
    "address article aside blockquote body center dd details div dl dt fieldset figure footer form gallery header "
    "hr main nav ol p poem section table tbody thead tfoot ul".split()
)
# Name spaces of pages whose links carry no text, and words of a redirect line.
_SILENT = r"(?:file|image|category|media|fichier|catégorie|datei|bild|kategorie|archivo|categoría|файл|категория)"
_REDIRECT = r"(?:redirect|redirection|weiterleitung|redirección|redireccion|перенаправление|ανακατευθυνση|転送|넘겨주기)"
# LaTeX commands that stand without an argument.
_BARE = (
    r"(?:item|par|noindent|centering|maketitle|tableofcontents|newline|newpage|clearpage|hline|ldots|dots|cdots|cdot|"
    r"LaTeX|TeX|alpha|beta|gamma|delta|epsilon|lambda|mu|sigma|theta|pi|omega|leq|geq|neq|times|infty|sum|int|prod|log|sqrt|frac|left|right|in)"
)

_UNSEEN = re.compile(f"[{INVISIBLE}\r]")
_ANY = re.compile(r"[<>&\[\]{}*#_`~=$\\|]|''|^[-+;:%]|^\d{1,3}[.)] |\n-{3,}", re.M)

_ESCAPED = re.compile(r"&(?:amp;)*lt;(?:/?[a-zA-Z][a-zA-Z0-9]*|!--)")
_COMMENT = re.compile(r"<!--(?:.*?-->|.*?(?=\n\n)|.*\Z)", re.S)
_VERBATIM = re.compile(r"<(pre|syntaxhighlight|source|templatedata)\b([^<>]*)(?<!/)>(.*?)(?:</\1\s*>|(?=\n\n\n)|\Z)", re.S | re.I)
_NOWIKI = re.compile(r"<nowiki\s*/>|<nowiki>(.*?)</nowiki\s*>", re.S | re.I)
_MATH_TAG = re.compile(r"<(math|chem|ce)\b[^<>]*>(.*?)</\1\s*>", re.S | re.I)
_SCRIPT = re.compile(r"<(script|style)\b[^<>]*>.*?(?:</\1\s*>|\Z)", re.S | re.I)
_REF = re.compile(r"<ref\b[^<>/]*/\s*>|<ref\b[^<>]*(?<!/)>.*?(?:</ref\s*>|(?=\n\n)|\Z)", re.S | re.I)
_INLINE_CODE_TAG = re.compile(r"<(code|tt|kbd|samp)\b[^<>]*>([^<>\n]*)</\1\s*>", re.I)
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)((?:\s[^<>]*)?)/?>")
_AUTOLINK = re.compile(r"<((?:https?|ftp|mailto):[^<>\s]+)>")
_CUT_TAG = re.compile(r"</?([a-zA-Z][a-zA-Z0-9]*)(?:(?:\s+[a-zA-Z][\w:-]*(?:\s*=\s*(?:\"[^\"<>\n]*\"?|'[^'<>\n]*'?|[^\s<>\"']*))?)+[ \t]*(?=\n|<|\Z)|/?\s*\Z)")
_CHARACTER = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z][a-zA-Z0-9]{1,31});?")
_CUT_NAMES = ("&nbsp", "&amp", "&lt", "&gt", "&quot", "&ldquo", "&rdquo", "&mdash", "&ndash", "&hellip")

_LANGUAGE = re.compile(r"^[ \t]*\{?\.?([A-Za-z][\w+#.-]*)")
_LANGUAGE_NAMED = re.compile(r"\blang(?:uage)?\s*=\s*[\"']?([A-Za-z][\w+#.-]*)")
_FENCE = re.compile(r"^(```+|~~~+)([^\n`]*)\n(.*?)(?:^\1[`~]*[ \t]*$|(?=\n\n\n)|\Z)", re.S | re.M)
_DISPLAY = re.compile(r"\$\$(?=\S)([^$]+?)\$\$|\\\[(.+?)\\\]|\\begin\{(equation|align|gather|multline|eqnarray|displaymath|math)(\*?)\}(.*?)(?:\\end\{\3\4\}|\Z)", re.S)
_INLINE_MATH = re.compile(r"\\\((.+?)\\\)|(?<![\w\\$])\$(?=[^\s$])([^$\n]*[\\_^{=][^$\n]*?)(?<=\S)\$(?![\w$])", re.S)
_VERB_ENV = re.compile(r"\\begin\{(verbatim|lstlisting|minted|alltt)\*?\}(?:\[[^\]]*\])?(?:\{[^{}]*\})?\n?(.*?)(?:\\end\{\1\*?\}|(?=\n\n\n)|\Z)", re.S)
_INLINE_CODE = re.compile(r"(?<![`\\])(`)(?!`)([^`\n]+(?:\n[^`\n]+)?)`(?!`)|(?<!`)``(?!`)(?=\s*\S)([^`\n]*(?:\n[^`\n]+)?)``(?!`)")

_REDIRECT_LINE = re.compile(rf"^[ \t]*#[ \t]*{_REDIRECT}\b[ \t]*:?", re.I | re.M)
_LANG = re.compile(r"\{\{\s*(?:lang|transl|nowrap|small)\s*\|(?:[^{}|]*\|)*([^{}|]*)\}\}", re.I)
_BRACES = re.compile(r"\{+|\}+")
_CUT_TEMPLATE = re.compile(r"\{\{\s*[\w#][^{}\n]*(?:\n[|][^{}\n]*)*\Z|^\}\}[ \t]*$|\{\{\s*[\w#][^{}\n]*(?=\n\n)", re.M)
_WIKI_TABLE = re.compile(r"^:*\{\|.*?(?:^\|\}|(?=\n\n)|\Z)", re.S | re.M)
_SILENT_LINK = re.compile(rf"\[\[\s*:?{_SILENT}\s*:(?:[^\[\]]|\[\[[^\[\]]*\]\])*\]\]", re.I)
_BRACKETS = re.compile(r"\[+|\]+|\|")
_CUT_LINK = re.compile(r"\[\[(?=[^\s\[\]])")
_OUTER_LINK = re.compile(r"\[((?:https?|ftp):)?//[^\s\[\]]+[ \t\n]?([^\[\]]*)\]")
_QUOTES = re.compile(r"(?<!')('{2,5})(?!')(?=\S)")
_HEADING = re.compile(r"^(={1,6})[ \t]*([^=\n][^\n]*?)[ \t]*\1[ \t]*$", re.M)
_MAGIC = re.compile(r"(?<!\w)__[A-Z]{3,}__(?!\w)")

_IMAGE = re.compile(r"!\[([^\[\]]*)\](?:\([^()\s]*(?:\s+\"[^\"]*\")?\)|\[[^\[\]]*\])")
_MD_LINK = re.compile(r"(?<!\])\[([^\[\]]+)\]\(([^()\s]*)(?:\s+\"[^\"]*\")?\)")
_MD_REFERENCE = re.compile(r"\[(?!\d{1,4}\])([^\[\]^][^\[\]]*)\]\s?\[((?:(?!\n\n)[^\[\]])*)\]")
_FOOTNOTE = re.compile(r"\[\^[^\[\]\s]+\](?::[ \t][^\n]*)?")
_DEFINITION = re.compile(r"^ {0,3}\[[^\[\]^\n]+\]:[ \t]+(?:<?https?:|/|www)\S*.*$", re.M)
_STRONG = re.compile(r"(?<![*\w])\*\*(?=[^\s*])((?:(?!\n\n)[^*])+?)(?<=[^\s*])\*\*(?!\*)")
_STRONG_LINE = re.compile(r"(?<![\w_])__(?=[^\s_])((?:(?!\n\n)[^_])+?)(?<=[^\s_])__(?![\w_])")
_EMPHASIS = re.compile(r"(?<![*\w\\])\*(?=[\w\"'“‘«(¿¡])((?:(?!\n\n)[^*])+?)(?<=[^\s*])\*(?![*\w])")
_EMPHASIS_LINE = re.compile(r"(?<![\w\\_])_(?=\w)((?:(?!\n\n)[^_])+?)(?<=[^\s_])_(?![\w_])")
_STRUCK = re.compile(r"(?<!~)~~(?=[^\s~])((?:(?!\n\n)[^~])+?)(?<=[^\s~])~~(?!~)")
_MD_HEADING = re.compile(r"^ {0,3}(#{1,6})[ \t]+(\S.*?)[ \t]*#*[ \t]*$")
_RULE_ROW = re.compile(r"^[ \t]*\|?[ \t]*:?-{2,}:?[ \t]*(?:\|[ \t]*:?-{2,}:?[ \t]*)+\|?[ \t]*$")
_UNDERLINE = re.compile(r"^(?:-{3,}|={3,})[ \t]*$")
_RULER = re.compile(r"^[ \t]{0,3}(?:-{3,}|\*{3,}|_{3,}|(?:\*[ \t]+){2,}\*)[ \t]*$")
_ITEM = re.compile(r"^[ \t]*(?:([*+-]|[*#:;]{1,6})(?=[ \t])|(\d{1,3})[.)](?=[ \t]))[ \t]+(\S.*)$")
_WIKI_ITEM = re.compile(r"^([*#:;]{1,6})[ \t]*([^\s*#:;].*)$")

_ENVIRONMENT = re.compile(r"\\(begin|end)\{([a-zA-Z]+\*?)\}(?:\[[^\]\n]*\])?((?:\{[^{}\n]*\})?)")
_SECTION = re.compile(r"\\(part|chapter|section|subsection|subsubsection|paragraph|title)\*?(?:\[[^\]\n]*\])?\{([^{}]*)\}")
_DROPPED = re.compile(r"[~ ]?\\(?:label|index|ref|eqref|pageref|cite[a-z]*|footnote|footnotetext|vspace|hspace|bibliography|bibliographystyle|usepackage|documentclass|includegraphics|input|include)\*?(?:\[[^\]\n]*\])*\{[^{}]*\}")
_HREF = re.compile(r"\\href\{[^{}]*\}\{([^{}]*)\}")
_URL = re.compile(r"\\url\{([^{}]*)\}")
_COMMAND = re.compile(r"(?<![\w:\\./])\\[a-zA-Z]+\*?(?:\[[^\]\n]*\])?\{|[{}]")
_ITEMS = re.compile(r"\\(begin|end)\{(itemize|enumerate|description)\*?\}(?:\[[^\]\n]*\])?|\\(item)(?![a-zA-Z])[ \t]*(?:\[[^\]\n]*\])?[ \t]*")
_AMPERSANDS = re.compile(r"&(?:amp;|#0*38;|#[xX]0*26;)+(?=[a-zA-Z#])")
_LONE = re.compile(rf"(?<![\w:\\./])\\{_BARE}(?![a-zA-Z])")
_CUT_COMMAND = re.compile(r"(?<![\w:\\./])\\[a-zA-Z]+\*?(?:\[[^\]\n]*\])?\{")
_ESCAPE = re.compile(r"(?<![\w:\\])\\([&%_#$])")
_TEX_QUOTES = re.compile(r"``(?!`)((?:(?!\n\n)[^`'])+(?:'(?!')(?:(?!\n\n)[^`'])+)*)''")
_TEX_COMMENT = re.compile(r"(?:(?<=\n\n)|\A)%[^\n]*(?=\n\n|\Z)|(?:(?<=\n\n)|\A)%[^\n]*(?=\n\\)|(?<=[}\]]\n)%[^\n]*")

_SLOT = re.compile("\x02(\\d+)\x03")
_MARK = re.compile("^\x01([a-z0-9]+)\x01(.*)$", re.S)
_LEVEL = {"part": 1, "chapter": 1, "title": 1, "section": 2, "subsection": 3, "subsubsection": 4, "paragraph": 5}


def kind(tag: str) -> str:
    """A tag without depth, number or language."""
    return "li" if tag[:2] == "li" else "pre" if tag[:3] == "pre" else tag


def _code(words: str, attribute: bool = False) -> str:
    """The tag of code whose opening sign has these words."""
    m = (_LANGUAGE_NAMED if attribute else _LANGUAGE).search(words)
    return f"pre-{m[1]}" if m else "pre"


class _Reader:
    """State of one parse: what is set aside, and the pieces met."""

    def __init__(self) -> None:
        self.held: list[Block] = []
        self.pieces = 0
        #: open lists: numbered or not, and how many items so far
        self.lists: list[list] = []

    def hold(self, tag: str, text: str, apart: bool = True) -> str:
        self.pieces += 1
        self.held.append((tag, text))
        slot = f"\x02{len(self.held) - 1}\x03"
        return f"\n\n{slot}\n\n" if apart else slot

    def sub(self, pattern: re.Pattern, to, text: str) -> str:
        text, n = pattern.subn(to, text)
        self.pieces += n
        return text

    def nested(self, t: str, signs: re.Pattern) -> str:
        """Templates (of braces) go, links (of brackets) become what stands after their first pipe,
        or all they hold. One pass with a stack, so of any depth. A sign that is single or has no
        partner stays, and with it what it stands in."""
        label = signs is _BRACKETS
        opening, closing = "[]" if label else "{}"
        out: list[str] = []
        stack: list[list] = []  # place of the run of opening signs, how many are left, first pipe
        start = 0
        for m in signs.finditer(t):
            out.append(t[start : m.start()])
            start, sign = m.end(), m[0]
            left = len(sign)
            if sign == "|":
                out.append(sign)
                if stack and stack[-1][2] is None:
                    stack[-1][2] = len(out)
                continue
            if sign[0] == opening:
                out.append(sign)
                if left == 1:
                    stack.clear()
                else:
                    stack.append([len(out) - 1, left, None])
                continue
            while left > 1 and stack:
                at, count, pipe = frame = stack[-1]
                take = 3 if not label and count == 3 and left > 2 else 2
                out[at] = opening * (count - take)
                if label:
                    del out[at + 1 : pipe or at + 1]
                else:
                    del out[at + 1 :]
                self.pieces += 1
                left -= take
                frame[1:] = [count - take, None]
                if frame[1] == 0:
                    stack.pop()
                elif frame[1] == 1:
                    stack.clear()
            if left:
                out.append(closing * left)
                stack.clear()
        out.append(t[start:])
        return "".join(out)

    def item(self) -> str:
        """The mark of one more item of the innermost open list."""
        if not self.lists:
            return "\n\x01li\x01"
        of = self.lists[-1]
        of[1] += 1
        return f"\n\x01li{len(self.lists)}{f'n{of[1]}' if of[0] else ''}\x01"

    def list(self, opens: bool, numbered: bool) -> None:
        if opens:
            self.lists.append([numbered, 0])
        elif self.lists:
            self.lists.pop()

    # -- verbatim parts -------------------------------------------------

    def verbatim(self, t: str) -> str:
        if "<" in t:
            t = _VERBATIM.sub(lambda m: self.hold(_code(m[2], attribute=True), html.unescape(re.sub(r"^<code[^<>]*>|</code\s*>\s*$", "", m[3].strip("\n"), flags=re.I))), t)
            t = _MATH_TAG.sub(lambda m: self.hold("math", m[2].strip(), apart=self._alone(m)), t)
            t = _NOWIKI.sub(lambda m: self.hold("text", m[1] or "", apart=False), t)
            t = self.sub(_SCRIPT, " ", t)
        if "```" in t or "~~~" in t:
            t = _FENCE.sub(lambda m: self.hold(_code(m[2]), m[3].strip("\n")), t)
        if "\\begin{" in t:
            t = _VERB_ENV.sub(lambda m: self.hold("pre", m[2].strip("\n")), t)
        if "$$" in t or "\\[" in t or "\\begin{" in t:
            t = _DISPLAY.sub(lambda m: self.hold("math", (m[1] or m[2] or m[5] or "").strip()), t)
        if "$" in t or "\\(" in t:
            t = _INLINE_MATH.sub(lambda m: self.hold("math", (m[1] or m[2]).strip(), apart=self._alone(m)), t)
        return t

    @staticmethod
    def _alone(m: re.Match) -> bool:
        """Whether a match fills its line."""
        s = m.string
        return (m.start() == 0 or s[m.start() - 1] == "\n") and (m.end() == len(s) or s[m.end()] == "\n")

    # -- HTML -----------------------------------------------------------

    def tag(self, m: re.Match) -> str:
        name = m[2].lower()
        if name not in ELEMENTS:
            return m[0]
        self.pieces += 1
        close = bool(m[1])
        if name[0] == "h" and name[1:].isdigit():
            return "\n\n" if close else f"\n\n\x01{name}\x01"
        if name == "li" or name == "dt" or name == "dd":
            return "\n" if close else self.item()
        if name in ("ul", "ol", "dl"):
            self.list(not close, name == "ol")
            # a list within an item goes on from it
            return "\n" if len(self.lists) > (0 if close else 1) else "\n\n"
        if name == "tr":
            return "\n" if close else "\n\x01tr\x01"
        if name in ("td", "th"):
            return "" if close else "\x04"
        if name == "br":
            return "\n"
        if name == "blockquote":
            return "\n\n" if close else "\n\n\x01quote\x01"
        return "\n\n" if name in _APART else ""

    def cut_tag(self, m: re.Match) -> str:
        if m[1].lower() not in ELEMENTS:
            return m[0]
        self.pieces += 1
        return ""

    def character(self, m: re.Match) -> str:
        if m[0][-1] != ";" and not m[0].startswith("&#") and m[0] not in _CUT_NAMES:
            return m[0]
        new = html.unescape(m[0])
        if new == m[0]:
            return new
        self.pieces += 1
        return {"\xa0": " ", "<": "\x05", ">": "\x06"}.get(new, new)

    def hypertext(self, t: str) -> str:
        if "<" in t:
            t = self.sub(_COMMENT, "", t)
            if "<ref" in t or "<REF" in t:
                t = self.sub(_REF, "", t)
            t = _INLINE_CODE_TAG.sub(lambda m: self.hold("code", html.unescape(m[2]), apart=False), t)
            t = self.sub(_AUTOLINK, r"\1", t)
            t = _TAG.sub(self.tag, t)
            if "<" in t:
                t = _CUT_TAG.sub(self.cut_tag, t)
        if "&" in t:
            t = _CHARACTER.sub(self.character, t)
        return t

    # -- wiki -----------------------------------------------------------

    def wiki_table(self, m: re.Match) -> str:
        self.pieces += 1
        rows: list[list[str]] = [[]]
        for line in m[0].split("\n")[1:]:
            line = line.strip()
            if line.startswith("|}"):
                break
            if line.startswith("|-") or line.startswith("|+"):
                rows.append([line[2:].strip()] if line.startswith("|+") and line[2:].strip() else [])
            elif line[:1] in ("|", "!"):
                cells = re.split(r"\|\||!!", line[1:])
                rows[-1].extend(re.sub(r"^[^|\[]*\|(?!\|)", "", c).strip() for c in cells)
            elif line and rows[-1]:
                rows[-1][-1] += " " + line
        return "\n\n" + "\n".join("\x01tr\x01" + "\x04".join(r) for r in rows if r) + "\n\n"

    def wiki(self, t: str) -> str:
        if "#" in t:
            t = self.sub(_REDIRECT_LINE, "", t)
        if "{{" in t or "}}" in t:
            t = self.sub(_LANG, r"\1", t)
            t = self.nested(t, _BRACES)
            t = self.sub(_CUT_TEMPLATE, "", t)
        if "{|" in t:
            t = _WIKI_TABLE.sub(self.wiki_table, t)
        if "[[" in t:
            t = self.sub(_SILENT_LINK, "", t)
            t = self.nested(t, _BRACKETS)
            t = self.sub(_CUT_LINK, "", t)
        if "//" in t and "[" in t:
            t = self.sub(_OUTER_LINK, r"\2", t)
        if "''" in t:
            t = self.sub(_TEX_QUOTES, "“\\1”", t)
            if "''" in t and _QUOTES.search(t):
                t, n = re.subn(r"'{2,5}", "", t)
                self.pieces += n
        if "==" in t or "\n=" in t or t.startswith("="):
            t = self.sub(_HEADING, lambda m: f"\n\n\x01h{len(m[1])}\x01{m[2]}\n\n", t)
        if "__" in t:
            t = self.sub(_MAGIC, "", t)
        return t

    # -- LaTeX ----------------------------------------------------------

    def environment(self, m: re.Match) -> str:
        self.pieces += 1
        name = m[2].rstrip("*")
        if name in ("quote", "quotation", "verse"):
            return "\n\n\x01quote\x01" if m[1] == "begin" else "\n\n"
        if name.startswith("tabular") or name in ("array", "longtable"):
            return "\n\n\x07" if m[1] == "begin" else "\x08\n\n"
        return "\n\n"

    def listing(self, m: re.Match) -> str:
        """An item, or an end of a list of LaTeX."""
        self.pieces += 1
        if m[3]:
            return self.item()
        self.list(m[1] == "begin", m[2] == "enumerate")
        return "\n" if len(self.lists) > (1 if m[1] == "begin" else 0) else "\n\n"

    def commands(self, t: str) -> str:
        """Commands around a text without their signs, whatever their depth; braces of other use stay."""
        out: list[str] = []
        opened: list[int] = []  # where the sign of each open command or brace stands
        start = 0
        for m in _COMMAND.finditer(t):
            out.append(t[start : m.start()])
            start = m.end()
            out.append(m[0])
            if m[0] != "}":
                opened.append(len(out) - 1)
            elif opened and out[opened[-1]] != "{":
                out[opened.pop()] = out[-1] = ""
                self.pieces += 1
            elif opened:
                opened.pop()
        out.append(t[start:])
        return "".join(out)

    @staticmethod
    def tabular(m: re.Match) -> str:
        rows = [r.strip() for r in re.split(r"\\\\", m[1].replace("\\hline", ""))]
        return "\n".join("\x01tr\x01" + "\x04".join(c.strip() for c in r.split("&")) for r in rows if r)

    def latex(self, t: str) -> str:
        if "%" in t:
            t = self.sub(_TEX_COMMENT, "", t)
        if "\\" not in t:
            return t
        t = self.sub(_SECTION, lambda m: f"\n\n\x01h{_LEVEL[m[1]]}\x01{m[2]}\n\n", t)
        t = self.sub(_DROPPED, "", t)
        t = self.sub(_HREF, r"\1", t)
        t = self.sub(_URL, r"\1", t)
        if "\\item" in t:
            self.lists.clear()
            t = _ITEMS.sub(self.listing, t)
        t = _ENVIRONMENT.sub(self.environment, t)
        if "\x07" in t:
            t = re.sub("\x07([^\x07\x08]*)(?:\x08|\\Z)", self.tabular, t)
        t = self.commands(t)
        t = self.sub(_CUT_COMMAND, "", t)
        t = self.sub(_ESCAPE, r"\1", t)
        return self.sub(_LONE, "", t)

    # -- Markdown -------------------------------------------------------

    def markdown(self, t: str) -> str:
        if "`" in t:
            t = _INLINE_CODE.sub(lambda m: self.hold("code", m[2] or m[3] or "", apart=False), t)
        if "[" in t:
            t = self.sub(_IMAGE, r"\1", t)
            t = self.sub(_MD_LINK, r"\1", t)
            t = self.sub(_FOOTNOTE, "", t)
            t = self.sub(_DEFINITION, "", t)
            t = self.sub(_MD_REFERENCE, r"\1", t)
        if "**" in t:
            t = self.sub(_STRONG, r"\1", t)
        if "*" in t:
            t = self.sub(_EMPHASIS, r"\1", t)
        if "__" in t:
            t = _STRONG_LINE.sub(self._strong_line, t)
        if "_" in t:
            t = self.sub(_EMPHASIS_LINE, r"\1", t)
        if "~~" in t:
            t = self.sub(_STRUCK, r"\1", t)
        return t

    def _strong_line(self, m: re.Match) -> str:
        if re.fullmatch(r"[a-z0-9]+", m[1]):  # an identifier
            return m[0]
        self.pieces += 1
        return m[1]

    # -- lines ----------------------------------------------------------

    def lines(self, t: str) -> list[Block]:
        blocks: list[Block] = []
        prose: list[str] = []
        rows = t.split("\n")
        n = len(rows)

        def end() -> None:
            if prose:
                text = "\n".join(prose).strip()
                if text:
                    blocks.append(("p", text))
                prose.clear()

        def add(tag: str, text: str) -> None:
            end()
            if text.strip():
                blocks.append((tag, text.strip()))

        i = 0
        while i < n:
            line = rows[i]
            s = line.strip()
            if not s:
                end()
                i += 1
                continue
            m = _MARK.match(s)
            if m:
                tag, text = m[1], m[2]
                # a heading, item or quotation may run on over wrapped lines
                while tag != "tr" and i + 1 < n and rows[i + 1].strip() and rows[i + 1].strip()[0] not in "\x01\x02" and not _ITEM.match(rows[i + 1]):
                    i += 1
                    text += " " + rows[i].strip()
                while tag == "tr" and i + 1 < n and rows[i + 1].lstrip().startswith("\x04"):
                    i += 1
                    text += rows[i].strip()
                if tag == "tr":
                    text = " | ".join(c.strip() for c in text.strip("\x04").split("\x04"))
                add(tag, text)
                i += 1
                continue
            m = re.fullmatch("\x02(\\d+)\x03", s)
            if m and kind(self.held[int(m[1])][0]) in ("pre", "math"):
                add(*self.held[int(m[1])])
                i += 1
                continue
            first = not prose
            # a pipe table: a row, a rule row, rows
            if "|" in s and i + 1 < n and _RULE_ROW.match(rows[i + 1]):
                self.pieces += 1
                end()
                while i < n and "|" in rows[i]:
                    if not _RULE_ROW.match(rows[i]):
                        add("tr", " | ".join(c.strip() for c in rows[i].strip().strip("|").split("|")))
                    i += 1
                continue
            if s[0] == "#":
                m = _MD_HEADING.match(line)
                near = (i + 1 < n and _WIKI_ITEM.match(rows[i + 1]) and rows[i + 1][0] == "#") or (i and rows[i - 1][:1] == "#")
                if m and not near and (first or (i + 1 < n and not rows[i + 1].strip())):
                    self.pieces += 1
                    add(f"h{len(m[1])}", m[2])
                    i += 1
                    continue
            if first and i + 1 < n and _UNDERLINE.match(rows[i + 1]) and not _UNDERLINE.match(line):
                self.pieces += 1
                add("h1" if rows[i + 1][0] == "=" else "h2", s)
                i += 2
                continue
            if _RULER.match(line) and (first or _UNDERLINE.match(line) or i + 1 == n or not rows[i + 1].strip()):
                self.pieces += 1
                end()
                i += 1
                continue
            if s[0] == ">" and len(s) > 1 and first:
                self.pieces += 1
                text = [s.lstrip("> \t")]
                while i + 1 < n and rows[i + 1].strip():
                    i += 1
                    text.append(rows[i].strip().lstrip("> \t"))
                add("quote", " ".join(text))
                i += 1
                continue
            if s[0] in "*+-#:;" or s[0].isdigit():
                run = self.items(rows, i)
                if run and (len(run) > 1 or (first and s[0] not in ":-")):
                    self.pieces += len(run)
                    for (_, text), tag in zip(run, self.tags(rows[i : i + len(run)], run)):
                        add(tag, text)
                    i += len(run)
                    continue
            prose.append(line.rstrip())
            i += 1
        end()
        return blocks

    @staticmethod
    def tags(rows: list[str], run: list[tuple[str, str]]) -> list[str]:
        """The tag of each item of a run, with its depth and number. Wiki items are as deep as they
        have signs, others as their indentation says; a numbered one starts at its own number."""
        found = []
        indents: list[int] = []
        counts: dict[int, int] = {}
        for line, (mark, _) in zip(rows, run):
            if mark == "1" or len(mark) == 1 and line[:1] in " \t":
                indent = len(line) - len(line.lstrip())
                while indents and indents[-1] > indent:
                    indents.pop()
                if not indents or indents[-1] < indent:
                    indents.append(indent)
                depth = len(indents)
            else:
                depth, indents = len(mark), [0]
            counts = {d: c for d, c in counts.items() if d <= depth}
            counts[depth] = counts.get(depth, 0) + 1
            number = re.match(r"[ \t]*(\d+)", line)
            if mark == "1" and number:
                counts[depth] = int(number[1])
            found.append(f"li{depth}" + (f"n{counts[depth]}" if mark == "1" or mark[-1] == "#" else ""))
        return found

    @staticmethod
    def items(rows: list[str], i: int) -> list[tuple[str, str]]:
        """The run of list items that starts at line i."""
        found: list[tuple[str, str]] = []
        before = None
        for line in rows[i:]:
            m = _ITEM.match(line)
            w = None if m else _WIKI_ITEM.match(line)
            if m and m[2]:
                number = int(m[2])
                if before is not None and number not in (before + 1, before):
                    break
                if before is None and number > 1 and not found:
                    break
                before = number
                found.append(("1", m[3]))
            elif m and before is None:
                found.append((m[1], m[3]))
            elif w and before is None and (len(w[1]) > 1 or w[1] in "*#;" or found):
                found.append((w[1], w[2]))
            else:
                break
        if len(found) == 1 and found[0][0] == "1":
            return []
        return found

    def restore(self, text: str) -> str:
        def back(m: re.Match) -> str:
            tag, inner = self.held[int(m[1])]
            return f"${inner}$" if tag == "math" else f"`{inner}`" if tag == "code" else inner

        if "\x02" in text:
            text = _SLOT.sub(back, text)
        return text.replace("\x05", "<").replace("\x06", ">").replace("\x04", " | ").replace("\x01", "")


def _paragraphs(text: str) -> list[Block]:
    return [("p", p.strip()) for p in re.split(r"\n[ \t]*\n", text) if p.strip()]


def parse(text: str | None) -> tuple[list[Block], int]:
    """The blocks of a text and its pieces of markup. Null and empty texts have neither."""
    if not text:
        return [], 0
    if not text.isascii() or "\r" in text:
        text = _UNSEEN.sub("", text.replace("\r\n", "\n"))
    if not _ANY.search(text):
        return _paragraphs(text), 0
    # control characters serve as marks below; they carry no text
    text = re.sub("[\x01-\x08]", "", text)
    reader = _Reader()
    if "&" in text and _ESCAPED.search(text):
        reader.pieces += 1
        before = ""
        while text != before and _ESCAPED.search(text):
            before, text = text, html.unescape(_AMPERSANDS.sub("&", text))
    text = reader.verbatim(text)
    text = reader.wiki(reader.hypertext(text)) if "<" in text or "&" in text else reader.wiki(text)
    if "\\" in text or "%" in text:
        text = reader.latex(text)
    text = reader.markdown(text)
    blocks = [(tag, body if kind(tag) in ("pre", "math") else reader.restore(body)) for tag, body in reader.lines(text)]
    return blocks, reader.pieces


def render(blocks: list[Block]) -> str:
    """Blocks as clean text."""
    out: list[str] = []
    last = ""
    for tag, text in blocks:
        if tag[0] == "h" and tag[1:].isdigit():
            text = "#" * int(tag[1]) + " " + " ".join(text.split())
        elif tag[:2] == "li":
            depth, _, number = tag[2:].partition("n")
            text = "  " * (int(depth or 1) - 1) + (f"{number}. " if number else "- ") + " ".join(text.split())
        elif tag[:3] == "pre":
            text = "```" + tag[4:] + "\n" + text + "\n```"
        elif tag == "math":
            text = "$$" + text + "$$"
        elif tag == "quote":
            text = "> " + " ".join(text.split())
        elif tag == "p":
            text = re.sub(r"[ \t]{2,}", " ", text)
        if out:
            out.append("\n" if kind(tag) == last and last in ("li", "tr") else "\n\n")
        out.append(text)
        last = kind(tag)
    return "".join(out)
