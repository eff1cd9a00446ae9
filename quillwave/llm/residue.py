"""Template residue, filler, error pages and script notices in place of content.

A text of a commit history has slots: its address slug (the host) and the paths
it changes, an author, a title, a body, and the changes.  All of the text is
read.  What stands in a slot, the response, is compared with the others:

1. Terms.  A response is *mismatched* if its words have hardly anything in
   common with the words of slug, paths and the other slots.
2. Detectors give evidence from 0 to 1, none alone is a verdict:
   placeholders (share of the slot that unfilled placeholders and their labels
   make up), filler (repetition, pseudo-Latin, keyboard runs) and pages (share
   of the words that belong to the vocabulary of error pages and script notices,
   if at least one expression says that something failed or is required).
   Quoted expressions are mentions and count as other words.
3. Host evidence.  The responses of all texts are cut into word shingles; a
   response is *duplicated* if most of its shingles stand on several hosts and
   for several authors.

A response is residue if its evidence is strong and it is mismatched, or if it
is weak, but the response says little, is mismatched and duplicated.  Text that
stands where the changes should, and isn't a well-formed change, is weakly
suspect without any detector.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillwave.session import materialise

#: Hosts and authors on which a duplicated response's shingles stand, words of a shingle, and the share of shingles.
HOSTS, AUTHORS, SHINGLE_WORDS, SIMILAR = 3, 5, 5, 0.8
#: A response says little with no more different words than this.
LOW_INFORMATION_WORDS = 30
#: Terms in common with the other slots, as a share, from which a response isn't mismatched.
COMMON_SHARE = 0.34


@dataclass(frozen=True)
class Limits:
    """From which share of a slot evidence is strong, and from which it is weak."""

    template: float = 0.75
    weak_template: float = 0.5
    page: float = 0.8
    weak_page: float = 0.5
    page_with_changes: float = 0.95
    filler: float = 0.9
    weak_filler: float = 0.5


LIMITS = Limits()

# The forms of placeholders.
_PLACEHOLDERS = [
    r"\{\{\s*[\w.\- ]+\s*\}\}", r"\$\{[\w.]+\}", r"%%\w+%%", r"%[A-Za-z_]\w+%", r"@@\w+@@", r"__[A-Z][A-Z0-9_]*__", r"<%=?\s*[\w.]+\s*%>", r"\{%\s*[\w.]+\s*%\}",
    r"<+(?:your|insert|enter|add|type) [\w ]+>+", r"<[\w ]+ (?:goes )?here>", r"\[(?:insert|your|enter|add|type) [\w ]+\]", r"&lt;[\w ]+&gt;",
    r"<!--\s*(?:enter|insert|your|add|type|describe)\b[^>]*-->", r"\[\[[\w\- ]+\]\]", r"\$Format:%\w+\$", r"%\(\w+\)[sd]", r"#\{[\w.]+\}",
    r"\{\w+\}", r"X{3,}: \w+ \(max \d+ characters\)", r"\bTODO: (?:describe|write|fill in) (?:the )?\w+", r"\[\w+ (?:name|title|text|description)\]", r"\bX{4,}\b", r"_{4,}",
]
# Words that templates put around their placeholders.
_TEMPLATE_WORDS = "summary subject title release of fix in merge into update by what changed why tested reviewed on for and the to from type scope description".split()
# The usual placeholder text of printers, and words that stand for any other.
_LOREM = (
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud "
    "exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur "
    "excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum fugit porta magnis tempus vestibulum quaerat nullam vitae"
).split()
_DUMMY_WORDS = "blah foo bar baz qux test testing sample dummy text asdf filler example placeholder xyz abc blindtext beispieltext platzhalter texte exemple texto ejemplo exemplo".split()
_KEY_ROWS = ("qwertyuiop", "asdfghjkl", "zxcvbnm")
# Words that carry no subject, in the languages of the texts.
_STOP = set(
    "a an the this that these those it its is are was were be been being am has have had do does did to of in on at by for from with as and or nor but if then so not no we you your our i they he she "
    "can could may might must will would should which who whom what when where why how there here all any some more most only just than too very into out up down over under "
    "der die das den dem des ein eine einen und oder ist sind war nicht zu im am auf mit von für wird wurde sie ihr es bei um le la les un une des du de et ou est sont pas pour dans sur vous nous ce cette il elle en au aux "
    "el los las una y o es son no se su por para con del al que lo em os as um uma e do da dos das não é na no para com seu sua que и в на не с по для это что к из как у вы мы".split()
)
# The vocabulary of error pages and of notices that scripts are required.
_PAGE_WORDS = set(
    "error errors err http https status code codes page pages found server servers internal gateway bad service temporarily temporary unavailable available request requests requested access denied forbidden "
    "unauthorized permission timeout timed time out took long load loaded loading reload refresh again try trying later back soon sorry oops whoops oh unable continue moved removed deleted blocked existed exist exists "
    "missing gone maintenance down went wrong something happened broke broken our side limited limit rate wait seconds second minutes minute many too come please contact support administrator webmaster owner tell happening keeps keep "
    "sign signed log logged login in see view viewing javascript java script scripts scripting js cookies cookie browser browsers enable enabled disable disabled turn turned switch switched on off allow allowed activate "
    "settings needs need required require requires works work run running without shown show display displayed depends uses use checking check verify verifying human robot captcha parts id trace reference ray host upstream reading response "
    "header proxy nginx apache cloudflare connection connect reached reach reset refused origin web site website address url link looking asked for home go start return visit menu search explore help skip content cannot can't couldn't reason build "
    "could not if cause caused unexpected occurred encountered problem trouble processing process completed failed failure invalid expired session quota exceeded overloaded busy capacity moment while right now longer properly correctly doesn't don't isn't we're we've mistyped address typed accessing fetching rendering expected "
    "commit commits list diff patch revision changeset file object resource document item repository viewer app application history message null undefined".split()
    + "fehler seite wurde gefunden nicht bitte einschalten aktivieren anzeigen sehen zu laden erneut versuchen server dienst verfügbar zugriff verweigert benötigt fortzufahren konnte geladen werden später".split()
    + "erreur page introuvable veuillez activer scripts afficher pour réessayer serveur service indisponible accès refusé continuer impossible charger plus tard trouvée".split()
    + "error página no encontró encontrada active activar navegador ver servidor servicio disponible acceso denegado continuar vuelva intentarlo más tarde".split()
    + "erro página não encontrada encontrado ative ativar navegador ver para servidor serviço indisponível acesso negado continuar tente novamente".split()
    + "ошибка страница не найдена найден включите просмотра сервер недоступен доступ запрещён запрещен необходимо включить работы сайта загрузить удалось повторите попытку позже".split()
)
# Expressions that say that something failed.
_FAILS = (
    r"not (?:be )?found|no longer exists?|(?:does|did) not exist|never existed|(?:could not|cannot|can't|couldn't|unable to|failed to) (?:be )?\w+|(?:was|were|been|has|have|or) (?:moved|removed|deleted|blocked|gone)|(?:un|not )available|out of reach|"
    r"denied|forbidden|unauthorized|time-?d? ?out|too long|bad gateway|internal (?:server )?error|too many requests|being limited|maintenance|went wrong|something broke|server is down|sign in to|oops|whoops|sorry|unexpected error|"
    r"quota exceeded|(?:has|have) expired|an? (?:\w+ )?error (?:has )?occurred|does ?n[o']t (?:exist|work)|checking your browser|connection (?:was )?(?:refused|reset)|konnte nicht|impossible d|не удалось|nicht (?:gefunden|verfügbar)|introuvable|indisponible|no se encontró|no encontrada|não encontrad[ao]|не найден[ао]?|недоступ\w+"
)
# Expressions that say that scripts are required.
_SCRIPTS = r"(?:java ?script|\bscripts?\b|\bscripting\b|\bjs\b)"
_REQUIRES = r"(?:enable|need|require|without|\boff\b|\bon\b|disabled|block|allow|depend|uses|only works|must|activ|ative|einschalten|aktivier|включить|включите|checking)"
# The same where words aren't spaced.
_UNSPACED = [
    r"(?:お探しの)?ページ(?:が|は)見つかりません(?:でした)?", r"エラー", r"アクセスできません", r"が?無効です", r"を?有効にしてください", r"(?:该|您访问的|此)?页面(?:未找到|不存在|无法显示)", r"错误", r"请(?:启用|开启|打开)", r"以?(?:查看|浏览|显示)(?:此)?(?:页面|内容|本页)?",
    r"ไม่พบหน้า(?:ที่ต้องการ|เว็บ)?", r"กรุณาเปิด(?:ใช้งาน)?", r"เพื่อ(?:ดู|แสดง)(?:หน้านี้|หน้า)?", r"服务器?(?:不可用|错误)", r"页(?:面)?",
]

_PLACEHOLDER = re.compile("|".join(_PLACEHOLDERS), re.I)
_SKELETON = set(_TEMPLATE_WORDS)
_SKIP = re.compile(r"(?:\+.*|backport-of: \w+|\(cherry picked from commit \w+\)|signed-off-by: .*|©.*|-- ?|\d+\.\d+)\s*", re.I)
_LATIN = re.compile(r"[a-z]{2,}(?:us|um|em|is|at|o|ae|unt|tur)")
_TAG = re.compile(r"<[^>]*>")
_LABEL = re.compile(r"(?:^|(?<=[\s(\[]))[^\W\d_][\w-]*:(?=\s|$)")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_TRAILER = re.compile(r"^\s*(?:tested|reviewed|reviewed-by|tested-by|why|what changed)\s*:\s*(.+?)\s*$", re.I | re.M)
_PERSON = re.compile(rf"^\W*(?:{'|'.join(_PLACEHOLDERS)})", re.I)
_QUOTED = re.compile(r"`[^`\n]*`|\"[^\"\n]*\"|(?<!\w)'[^'\n]*'(?!\w)|“[^”\n]*”|«[^»\n]*»|「[^」\n]*」")
_REPORTED = re.compile(r"\b(?:had|has|said|says|showed|shows|saw|reads?|printed|prints|returned|returns|got|was|were|reported|logged):\s.*$", re.I)
_STATUS = re.compile(r"(?<![\w.-])[45]\d\d(?![\w.-]*\w)")
_FAIL = re.compile(_FAILS)
_SCRIPT, _REQUIRED = re.compile(_SCRIPTS), re.compile(_REQUIRES)
_NO_SPACES = re.compile("|".join(_UNSPACED))
_WIDE = re.compile(r"[぀-ヿ㐀-鿿฀-๿]")
_ID = re.compile(r"\b(?=\w*\d)[0-9a-f]{6,}\b|\d+")


def _near(words: list[str]) -> set[str]:
    """Each word with every letter in turn left open, and its beginnings of five letters and more."""
    out = set(words)
    for w in words:
        if len(w) > 3:
            out |= {f"{w[:i]}*{w[i + 1 :]}" for i in range(len(w))}
        out |= {w[:i] for i in range(5, len(w))}
    return out


_NEAR_LOREM = _near([w for w in _LOREM if len(w) > 3]) | {w for w in _LOREM if w not in _STOP}


def _keyboard(word: str) -> bool:
    """Four or more keys of one row, each beside the one before."""
    return len(word) > 3 and any(all(abs(row.find(a) - row.find(b)) == 1 for a, b in zip(word, word[1:], strict=False)) for row in _KEY_ROWS if set(word) <= set(row))


def _lorem(word: str) -> bool:
    return word in _NEAR_LOREM or (len(word) > 3 and any(f"{word[:i]}*{word[i + 1 :]}" in _NEAR_LOREM for i in range(len(word)))) or (len(word) > 5 and word[:4] in ("cons", "vest", "adip"))


def _content(slot: str) -> str:
    """The slot's lines without trailers, footers and stray diff lines, in one line."""
    lines = (line.strip() for line in slot.split("\n"))
    return " ".join(" ".join(line for line in lines if line and not _SKIP.fullmatch(line)).split())


def terms(text: str) -> set[str]:
    """The words of a slug, path or slot that name a subject."""
    return {w for w in _WORD.findall(text.lower()) if len(w) > 2 and w not in _STOP}


def unquoted(content: str) -> str:
    """The text with what it quotes or reports replaced by one other word; a text that is one quotation is what it quotes."""
    if _TAG.sub("", content).lstrip()[:1] in ("{", "["):
        return content  # not prose
    whole = _QUOTED.fullmatch(content)
    return _REPORTED.sub(" quotation ", _QUOTED.sub(" quotation ", content[1:-1] if whole else content))


def placeholder_share(content: str) -> float:
    """Placeholders and the labels before them, as a share of them and all other words.

    Words that templates put around placeholders count for neither side.
    """
    found = _PLACEHOLDER.findall(content)
    if not found:
        return 0.0
    # \0 stands for a placeholder, so that a label before the last one is told from one after it
    masked = _PLACEHOLDER.sub(" \0 ", content)
    before, after = masked[: masked.rindex("\0")], masked[masked.rindex("\0") :]
    rest, labels = _LABEL.subn(" ", before)
    other = sum(w not in _SKELETON for w in _WORD.findall((rest + after).lower()))
    filled = len(found) + labels
    return filled / (filled + other)


def filler_share(content: str) -> float:
    """1 for one phrase again and again, else the share of filler words; short repetitions are weak evidence."""
    text = _TAG.sub(" ", content).strip().lower()
    words = _WORD.findall(text)
    if re.fullmatch(r"(.{1,40}?)\1{2,}", text + " ") and len(text) >= 8:
        known = sum(w in _DUMMY_WORDS or _lorem(w) or _keyboard(w) for w in words)
        return 1.0 if len(words) > 5 or 2 * known >= len(words) or not text.isascii() else LIMITS.weak_filler
    if len(text) >= 6 and not text.isascii() and re.fullmatch(r"(.{2,20}?)\1{2,}", text):
        return 1.0
    if len(words) < 4 or sum(w in _STOP and not _lorem(w) for w in words) > len(words) / 10:
        return 0.0
    mash = sum(map(_keyboard, words)) / len(words)
    if len(words) < 6:
        return mash
    share = sum(_lorem(w) or bool(_LATIN.fullmatch(w)) for w in words) / len(words)
    if share >= 0.5 and (sum(w in _LOREM for w in words) > 1 or sum(map(_lorem, words)) > 3):
        return 1.0  # the usual text itself, some of its words distorted
    return max(mash, share)


def page_share(content: str) -> float:
    """The share of the letters in words of error pages and script notices; 0 if nothing says what failed or is required."""
    text = " ".join(_TAG.sub(". ", content).lower().split())
    status, failed = _STATUS.search(text), _FAIL.search(text)
    if not (status or failed or _SCRIPT.search(text) and (_REQUIRED.search(text) or _WIDE.search(text)) or _NO_SPACES.search(text)):
        return 0.0
    covered = 0
    if _WIDE.search(text):
        covered = sum(len(_WIDE.findall(m)) for m in _NO_SPACES.findall(text))
        if not covered:
            return 0.0
        text = _NO_SPACES.sub(" ", text)
        other = len(_WIDE.findall(text))
        text = _WIDE.sub(" ", text)
    else:
        other = 0
    for w in _WORD.findall(_ID.sub(" ", text)):
        if w in _PAGE_WORDS or "script" in w:
            covered += len(w)
        elif w not in _STOP:
            other += len(w)
    if not covered and status and not other:
        return 1.0  # nothing but a status
    return covered / (covered + other) if covered else 0.0


def anchors(content: str) -> int:
    """How many expressions of an error page or script notice there are."""
    text = content.lower()
    return len(_STATUS.findall(text)) + len(_FAIL.findall(text)) + len(_SCRIPT.findall(text)) + len(_NO_SPACES.findall(text))


def shingles(content: str) -> list[str]:
    """The different word shingles of a response, without what differs from one occurrence to the next; a shorter one is its own."""
    text = _PLACEHOLDER.sub(" 0 ", _TAG.sub(" ", content)).lower()
    words = _ID.sub("0", text).split()
    return sorted({" ".join(words[i : i + SHINGLE_WORDS]) for i in range(max(1, len(words) - SHINGLE_WORDS + 1))})


_COMMIT = re.compile(r"commit [0-9a-f]{7,40}\b")
_MAIL = re.compile(r"From [0-9a-f]{40}\b")
_FIELDS = re.compile(r"author: ")
_SHORT = re.compile(r"([0-9a-f]{7,12}) ([^:\n]*): (.*)")


def slots(head: str) -> dict[str, str]:
    """author, message and rest (what stands where the changes should) of a text before its first diff.

    A text in none of the known layouts is all rest.  ``unsure`` is set where
    the rest may also be the end of the message.
    """
    lines = head.split("\n")
    at = next((i for i, x in enumerate(lines[:3]) if _COMMIT.match(x) or _MAIL.match(x) or _FIELDS.match(x) or _SHORT.match(x)), None)
    if at is None:
        return {"author": "", "message": "", "rest": head}
    first, lines, author, message, i = lines[at], lines[at:], "", [], 1
    if _COMMIT.match(first):
        while i < len(lines) and lines[i].strip():
            author = lines[i][7:].strip() if lines[i].startswith("Author:") else author
            i += 1
        while i < len(lines) and (not lines[i].strip() or lines[i].startswith("    ") or lines[i].startswith("+")):
            message.append(lines[i].strip())
            i += 1
    elif _MAIL.match(first):
        while i < len(lines) and not lines[i].startswith("Subject:"):
            author = lines[i][5:].strip() if lines[i].startswith("From:") else author
            i += 1
        while i < len(lines) and lines[i].strip() != "---":
            message.append(re.sub(r"^Subject: (?:\[PATCH[^\]]*\] ?)?", "", lines[i]))
            i += 1
        i += 1
    elif _FIELDS.match(first):
        author = first[8:].strip()
        while i < len(lines) and not lines[i].startswith("sha:"):
            message.append(re.sub(r"^message: ", "", lines[i]).strip())
            i += 1
        i += 1
    else:
        found = _SHORT.match(first)
        author, message = found[2], [found[3]]
        blocks = "\n".join(lines[1:]).strip("\n").split("\n\n")
        # without another mark, the last paragraph may stand where the changes should
        return {"author": author, "message": "\n".join([*message, *blocks[:-1]]), "rest": blocks[-1], "unsure": "rest"}
    return {"author": author, "message": "\n".join(message), "rest": "\n".join(lines[i:])}


_SECTION = re.compile(r"^diff --git (.*)$", re.M)
_BODY = re.compile(r"^(?:@@ -\d+(?:,\d+)? \+\d+(?:,\d+)? @@|Binary files .* differ$|GIT binary patch$|(?:old|new) mode \d+|(?:deleted|new) file mode \d+|(?:rename|copy) from )", re.M)
_STRAY = re.compile(r"^(?![ +\-\\]|@@ |diff --git |index [0-9a-f]|(?:old|new|deleted) (?:file )?mode |(?:dis)?similarity index |(?:rename|copy) (?:from|to) |Binary files |GIT binary patch$|(?:literal|delta) \d).*\S.*$", re.M)
_BASE85 = re.compile(r"[A-Za-z](?:[!-~]{5})+")


def changes(diff: str) -> tuple[str, str, bool]:
    """(paths, text in the changes that is none, whether any section is well-formed) of a text from its first diff on.

    Lines of hunks and of headers and encoded binaries are changes.  All that
    stands in a section without any is text in place of it.
    """
    paths, stray, good = [], [], False
    starts = [m.start() for m in _SECTION.finditer(diff)]
    for a, b in zip(starts, [*starts[1:], len(diff)], strict=True):
        section = diff[a:b]
        head, _, body = section.partition("\n")
        paths.append(head[11:])
        if _BODY.search(body):
            good = True
            found = _STRAY.findall(body)
            stray += [x for x in found if not _BASE85.fullmatch(x)] if found and "GIT binary patch" in body else found
        else:
            stray += [x for x in body.split("\n") if not x.startswith(("index ", "--- a/", "--- /dev", "+++ b/", "+++ /dev"))]
    return " ".join(paths), "\n".join(stray), good


@dataclass
class Verdict:
    """What one text's slots tell: residue by itself, or the shingles of a response that others have to confirm."""

    flagged: bool = False
    weak: list[str] | None = None
    strong: list[str] | None = None


def _evidence(content: str, limits: Limits, with_changes: bool, message: bool, quotes: bool) -> tuple[bool, bool, str]:
    """(strong, weak, kind) of a slot's content by the detectors; ``quotes`` tells that it may quote others."""
    text = unquoted(content) if quotes else content
    p = placeholder_share(text)
    if p >= limits.template:
        return True, True, "template"
    f = filler_share(text)
    if f >= limits.filler:
        return True, True, "filler"
    e = page_share(text)
    if e >= (limits.page_with_changes if with_changes and message else limits.page) and (not (with_changes and message) or anchors(text) > 1):
        return True, True, "page"
    return False, p >= limits.weak_template or f >= limits.weak_filler or e >= limits.weak_page, "page"


def judge(text: str | None, slug: str | None, limits: Limits = LIMITS, mismatch: bool = True) -> Verdict:
    """The verdict on one text; line ends are ``\\n``."""
    out = Verdict()
    if not text or not text.strip():
        return out
    at = ("\n" + text).find("\ndiff --git ")
    head, diff = (text, "") if at < 0 else (text[: max(at - 1, 0)], text[at:])
    paths, stray, good = changes(diff) if diff else ("", "", False)
    found = slots(head)
    if found["author"] and _PERSON.match(found["author"]):
        return Verdict(flagged=True)
    if any(placeholder_share(unquoted(m)) >= limits.template for m in _TRAILER.findall(found["message"])):
        return Verdict(flagged=True)
    lines = found["message"].strip("\n").split("\n")
    title, message, rest, stray = _content(lines[0]), _content(found["message"]), _content(found["rest"]), _content(stray)
    address = terms(f"{slug or ''} {paths}")
    for slot, content, others in (("message", message, address), ("title", title if title != message else "", address), ("rest", rest, address | terms(message)), ("changes", stray, address | terms(message))):
        if not content:
            continue
        unsure = slot == "rest" and "unsure" in found
        in_message = slot in ("message", "title") or (slot == "rest" and good)  # beside good changes nothing stands in their place
        strong, weak, kind = _evidence(content, limits, good, in_message, in_message or unsure)
        # text in place of changes is suspect by its place
        weak = weak or not (in_message or good or unsure)
        if not weak:
            continue
        own = terms(content)
        apart = not mismatch or kind == "template" or not own or len(own & others) < COMMON_SHARE * len(own)
        if strong and apart:
            return Verdict(flagged=True, strong=shingles(content))
        if apart and slot != "title" and not (in_message and good) and len(set(_WORD.findall(content.lower()))) <= LOW_INFORMATION_WORDS:
            out.weak = shingles(content)
    return out


def residue(df: DataFrame, key: str, text: str, host: str, author: str, limits: Limits = LIMITS, mismatch: bool = True, duplicates: bool = True) -> DataFrame:
    """(key) of every text that holds residue in place of content.

    Whole texts are judged, changes included; what a well-formed diff adds or
    removes is content.  NULL, empty and blank texts are none, nor are rows
    with a NULL key.  A NULL host is a host, a NULL author an author.  Repeated
    rows are judged alike and come out once.  An empty table gives an empty
    result; further columns are ignored.  ``mismatch`` and ``duplicates``
    switch the comparison of terms and the host evidence off, for measuring.
    """
    kind = df.schema[key].dataType.simpleString()
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).alias("_key"), F.coalesce(F.col(host), F.lit("")).alias("_host"), F.coalesce(F.col(author), F.lit("")).alias("_author"), F.regexp_replace(F.col(text), "\r\n?", "\n").alias("_text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [judge(t, s, limits, mismatch) for t, s in zip(b["_text"], b["_host"], strict=True)]
            b = b[["_key", "_host", "_author"]].assign(flagged=[v.flagged for v in found], response=[v.strong or v.weak for v in found])
            yield b[b["flagged"] | b["response"].notna()]

    suspects = materialise(rows.mapInPandas(run, f"_key {kind}, _host string, _author string, flagged boolean, response array<string>"), "suspects")
    flagged = suspects.where("flagged").select("_key")
    if not duplicates:
        return flagged.distinct().select(F.col("_key").alias(key))
    parts = suspects.select("_key", "_host", "_author", "flagged", F.explode("response").alias("shingle"))
    # of a shingle on very many hosts only the distinct ones are counted, combined before the shuffle
    seen = parts.select("shingle", "_host", "_author").distinct()
    spread = seen.groupBy("shingle").agg(F.count_distinct("_host").alias("hosts"), F.count_distinct("_author").alias("authors"))
    wide = spread.where((F.col("hosts") >= HOSTS) & (F.col("authors") >= AUTHORS)).select("shingle", F.lit(1).alias("_wide"))
    weak = parts.where("NOT flagged").select("_key", "shingle").distinct()
    shared = weak.join(wide, "shingle", "left").groupBy("_key").agg(F.count(F.lit(1)).alias("n"), F.count("_wide").alias("shared"))
    confirmed = shared.where(F.col("shared") >= SIMILAR * F.col("n")).select("_key")
    return flagged.unionByName(confirmed).distinct().select(F.col("_key").alias(key))
