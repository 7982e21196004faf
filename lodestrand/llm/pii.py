"""Problem 9: personal information inside free text.

Anchor expansion. One Aho-Corasick pass over each whole text, in lower case and with every digit written as 0,
finds all anchors: at-signs and their spellings, identifier and telephone cues, the shapes in which numbers
begin, street words, titles, role labels, verbs of asking and saying, and common given names. A deterministic
local parser expands each anchor to the left and right and validates what it finds: label structure of
domains, digit groups of telephone plans, check digits and blocked ranges of identifiers, house numbers,
shapes of names. Nothing is found without an anchor. The earlier parser keeps its span.

Identifiers: a resident number needs a valid date and check digit; a tax number needs a cue before it (documents carry
misprinted ones), or its groups of digits, digit counts and check digit; a social security number must not use area 000 or 666, group
00 or serial 0000, nor follow a word that names another kind of number; an insurance number needs a prefix
that may be issued (or QQ, the specimen prefix) or a cue; a passport number needs a cue. A cue reaches to the
first number of its sentence or line.

Names: a candidate of the right shape is taken if its evidence adds up to 2. A title, a role label, a verb of
asking before it or of saying after it give 2; prepositions, verbs that things share with persons and the
begin of a clause give 1; a common given name gives 2 (1 in lower case), an initial before the family name 1.
Candidates with words that no name has (articles, months, terms of this field) are dropped.

Full-width digits and signs are read as ASCII, one for one, so that positions in the text stay valid.

Defined results: NULL, empty and blank texts have no pieces and are returned as they are; each piece is
listed once per document and type; very long texts and pieces are processed whole.
"""

from __future__ import annotations

import functools
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import islice

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

# ---------------------------------------------------------------- fixed values: words and shapes

EMAIL_SIGNS = ("@", "(at)", "[at]", "{at}", "( at )", "[ at ]", " at ")
TAX_CUES = ("steuer-id", "steuernummer", "steueridentifikationsnummer", "steuer-identifikationsnummer", "kennnummer", "idnr", "tax id", "tax number", "tin")
PASS_CUES = ("passport", "travel document", "reisepass", "ausweis", "passnummer", "护照", "uid_doc", "通行证")
NATIONAL_CUES = ("national insurance", "ni no", "nino", "ni number", "uid_doc", "insurance number")
PHONE_CUES = ("phone", "tel", "fax", "call", "mobile", "cell", "pager", "ring", "text me", "whatsapp", "handy", "durchwahl", "rufnummer", "anrufen", "电话", "手机", "拨打", "联系方式", "致电", "传真")
# Shapes in which numbers begin (0 is any digit).
PHONE_STARTS = ("+0", "+ 0", "+(0", "(+0", "(0", "000-", "000.", "000 ", "000/", "0000-", "0000 ", "0000/", "00000 ", "00000-", "00000/", "0-000", "0 000", "0.000", "0 (0", "0-(0", "00000000000", "00000000000000")
STREET_EN = (
    "street", "st", "avenue", "ave", "road", "rd", "boulevard", "blvd", "lane", "ln", "drive", "dr", "court", "ct", "way", "place", "pl", "square", "sq",
    "terrace", "close", "crescent", "parkway", "highway", "row", "walk", "mews",
)
STREET_DE = ("straße", "strasse", "str.", "weg", "allee", "platz", "gasse", "damm", "ufer", "ring", "pfad", "steig", "chaussee", "promenade")
STREET_DE_BEFORE = ("am", "an der", "an den", "zum", "zur", "im", "auf der", "auf dem", "unter den", "in der", "hinter der")
STREET_ZH = ("大道", "大街", "路", "街", "巷", "弄", "胡同")
ZH_BEFORE_ADDRESS = "省市区县镇乡村在往到于址是给从去了为住：:，,"
TITLES = ("dr.", "prof.", "mr.", "mrs.", "ms.", "mr", "mrs", "ms", "dr", "prof", "miss", "sir", "madam", "frau", "herr", "herrn", "dipl.-ing.", "sra.", "mme")
LABELS = (
    "author", "co-author", "owner", "reviewer", "assignee", "reporter", "approver", "maintainer", "contact", "contact person", "name", "full name", "signed", "on call",
    "engineer", "analyst", "manager", "team lead", "tester", "developer", "attendee", "requester", "reviewed-by", "signed-off-by", "reported-by", "acked-by",
    "tested-by", "co-authored-by", "suggested-by", "approved-by", "from", "attn", "cc", "autor", "autorin", "verfasser", "verfasserin", "prüfer", "prüferin", "melder",
    "ansprechpartner", "ansprechpartnerin", "kontakt", "bearbeiter", "bearbeiterin", "zuständig", "unterzeichnet", "gezeichnet", "gez.",
)
DONE_BY = (
    "reviewed", "written", "signed", "approved", "reported", "fixed", "found", "prepared", "submitted", "requested", "raised", "confirmed", "noticed", "drafted", "filed",
    "checked", "tested", "patch", "fix", "commit", "review", "report", "analysis", "note", "change",
)
DONE_BY_DE = ("geprüft", "gemeldet", "verfasst", "geschrieben", "freigegeben", "bestätigt", "behoben", "unterschrieben", "bearbeitet", "erstellt", "eingereicht")
ASKING = (
    "asked", "ask", "told", "tell", "thanks", "thanks,", "thank", "thanks to", "contact", "contacted", "call", "called", "email", "emailed", "met", "ping", "pinged", "notify",
    "assigned to", "assign to", "forwarded to", "handed to", "escalated to", "spoke to", "spoke with", "speak to", "talk to", "talked to", "meeting with", "hi", "hello", "dear", "hallo", "liebe",
    "lieber", "bitte", "fragte", "fragen sie", "kontaktieren sie", "laut", "danke", "danke,", "zugewiesen an", "weitergeleitet an", "my name is", "i am", "i'm", "ich heiße",
    "mein name ist", "according to", "named", "namens", "--",
)
WEAK_BEFORE = ("by", "from", "with", "to", "and", "for", "von", "an", "mit", "bei", "und", "für", "hatte", "hat", "is", "was", "ist", "war", "did", "does", "has")
SAYING = (
    "says", "said", "wrote", "writes", "asks", "asked", "reports", "reported", "confirms", "confirmed", "signed", "approved", "approves", "thinks", "thought", "noticed", "suggested",
    "suggests", "explained", "agreed", "agrees", "disagrees", "replied", "mentioned", "promised", "believes", "objected", "sagt", "sagte", "meint", "meinte", "schreibt", "schrieb", "fragt", "bestätigt",
    "bestätigte", "meldet", "meldete", "findet", "glaubt", "erklärte", "hält", "joined", "left the team", "retired",
)
WEAK_AFTER = (
    "never", "has", "had", "was", "is", "will", "moves", "moved", "found", "fixed", "hat", "hatte", "ist", "war", "wird", "schon", "reicht", "can", "should", "wants", "knows", "about",
    "at", "on", "and", "und",
)
GIVEN_NAMES = (
    "aaron", "adam", "ahmed", "aisha", "alan", "albert", "alex", "alexander", "ali", "alice", "amara", "amelia", "amy", "ana", "andrea", "andreas", "andrew", "angela", "anna", "anne",
    "anselm", "anthony", "antonio", "aoife", "arthur", "ayesha", "barbara", "ben", "benjamin", "bernd", "bram", "brian", "carla", "carlos", "caroline", "catherine", "charles", "charlotte", "chris", "christian",
    "christina", "christine", "claire", "clara", "claudia", "corin", "daniel", "dario", "david", "deborah", "dennis", "diana", "dieter", "edward", "elena", "elizabeth", "ella", "emeka", "emily", "emma", "eric",
    "erik", "eva", "fatima", "felix", "fiona", "frank", "freya", "gabriel", "george", "greta", "hana", "hannah", "hans", "heike", "heinrich", "helen", "helga", "henry", "idris", "ilse", "ingrid", "isabel", "ivan", "jack",
    "jakob", "james", "jana", "jane", "jennifer", "jessica", "joanna", "johannes", "john", "jonas", "jonathan", "jose", "joseph", "juan", "julia", "jürgen", "karen", "karin", "kasper", "katharina", "kenji", "kevin", "klaus",
    "kumar", "laura", "leon", "leonie", "levi", "linda", "lisa", "lucas", "lucia", "luis", "lukas", "mara", "marco", "margaret", "maria", "marie", "markus", "martin", "mary", "matthew", "matthias", "michael", "miguel", "milo", "mohammed",
    "monika", "nadia", "nancy", "nicole", "nina", "noor", "odette", "olga", "oliver", "otis", "otto", "patricia", "paul", "peter", "petra", "philip", "priya", "rachel", "rebecca", "renzo", "richard", "robert", "ruben", "ruth",
    "sabine", "samuel", "sandra", "sarah", "sebastian", "selma", "sofia", "sophie", "stefan", "stephen", "susan", "sven", "thomas", "tobias", "tomas", "ursula", "werner", "william", "wolfgang", "wren", "yuki", "yusra",
)
SURNAMES_ZH = (
    "王李张刘陈杨黄赵吴周徐孙马朱胡郭何林高罗郑梁谢宋唐许韩冯邓曹彭曾萧田董潘袁蔡蒋余于杜叶程魏苏吕丁任卢姚沈钟姜崔谭陆范汪廖石金韦贾夏付方邹熊白孟秦邱侯江尹薛闫段雷龙黎史陶贺毛郝顾龚邵万覃武钱戴严莫孔向常"
)
LONG_SURNAMES_ZH = ("欧阳", "司马", "诸葛", "上官", "司徒", "东方", "慕容", "皇甫")
LABELS_ZH = ("审核人", "作者", "联系人", "负责人", "姓名", "报告人", "申请人", "经办人", "收件人", "提交人", "测试员", "工程师", "开发者", "评审人", "责任人", "签字", "复核人", "处理人")
BEFORE_ZH = ("请转给", "转给", "交给", "由", "联系", "询问", "通知", "感谢", "抄送给", "抄送", "和", "与", "跟", "给", "请", "找", "问了", "据")
AFTER_ZH = ("确认", "负责", "处理", "说", "认为", "表示", "已离开", "批准", "报告", "指出", "审核", "提交", "先生", "女士", "同事", "经理", "修复", "发现", "写道", "建议", "回复", "签字", "休假", "告诉", "完成", "同意")
NOT_NAMES_ZH = frozenset("方式 方法 方向 方案 任务 任何 高度 高级 余下 于是 白名 金额 严重 江湖 石头 温度 施工 向量 常量 常见 段落 段错 白盒 任意 路径 相关 马上 于其 万一 谢谢 钱包 华为".split())
# Words that no name has: articles and pronouns, days and months, terms of programs and reports.
NOT_NAMES = frozenset(
    "the this that these those there here what when where which who why how both all any some each every no not nobody none and or but if it its he she they we you i a an in on at of to for from by with as is are was "
    "das die der dem den des ein eine einen einer er sie es wir ihr beide erster zwischen für wiederholung läuft und oder aber wenn nicht kein keine im am an auf aus bei mit nach von zu zum zur "
    "yesterday today tomorrow gestern heute morgen monday tuesday wednesday thursday friday saturday sunday january february march april may june july august september october november december montag dienstag mittwoch donnerstag freitag samstag sonntag "
    "januar februar märz mai juni juli oktober dezember "
    "queue ring buffer lane block route table owner author reviewer team list path taint source sink node edge graph heap stack cache index key token packet frame session record window label field slot entry batch cursor "
    "option header payload message prefix length size value data code test build version file line function class method module system server client user admin root support security review report patch fix bug issue "
    "ticket task job run error warning info debug trace log thread process memory kernel device driver network socket port address phone email name number passport account street road avenue city thanks thank dear hello hi "
    "hallo danke please bitte note todo return null true false new old first last next previous input output check guard loop call callers callee depth limit effort replay why because after before between since while".split()
)

PLACEHOLDERS = {"email": "[EMAIL]", "phone": "[PHONE]", "identity": "[ID]", "address": "[ADDRESS]", "name": "[NAME]"}

# ---------------------------------------------------------------- the automaton

_WIDE = {0xFF10 + k: 0x30 + k for k in range(10)} | {
    0xFF0B: "+", 0xFF0D: "-", 0xFF20: "@", 0xFF08: "(", 0xFF09: ")", 0xFF0E: ".", 0x3000: " ", 0xA0: " ", 0x2011: "-", 0x2010: "-", 0x2013: "-",
}
_LOWER = {k: k + 32 for k in (*range(65, 91), *range(0xC0, 0xD7), *range(0xD8, 0xDF))}
_SHAPE = _LOWER | {k: "0" for k in range(0x31, 0x3A)}


@functools.lru_cache(maxsize=1)
def _anchors() -> ahocorasick.Automaton:
    kinds: dict[str, set[str]] = {}
    for kind, words in (
        ("email", EMAIL_SIGNS), ("tax", TAX_CUES), ("pass", PASS_CUES), ("national", NATIONAL_CUES), ("phone", PHONE_STARTS), ("call", PHONE_CUES),
        ("resident", ("0" * 17,)), ("taxrun", ("00 000 000 000",)), ("ssn", ("000-00-0000", "000 00 0000")), ("nino", ("000000", "00 00 00")),
        ("en", tuple(f" {w}" for w in STREET_EN)), ("de", STREET_DE), ("de_before", tuple(f"{w} " for w in STREET_DE_BEFORE)), ("zh", STREET_ZH),
        ("title", tuple(f"{w} " for w in TITLES)), ("label", tuple(f"{w}{s}" for w in LABELS for s in (":", "(", "="))),
        ("ask", tuple(f"{w} " for w in ASKING)), ("ask", tuple(f"{w} by " for w in DONE_BY)), ("ask", tuple(f"{w} von " for w in DONE_BY_DE)),
        ("weak", tuple(f"{w} " for w in WEAK_BEFORE)), ("says", tuple(f" {w}" for w in SAYING)), ("weak_after", (*(f" {w}" for w in WEAK_AFTER), "'s ", "’s ")),
        ("given", GIVEN_NAMES), ("zh_label", LABELS_ZH), ("zh_before", BEFORE_ZH), ("zh_after", AFTER_ZH),
    ):
        for word in words:
            kinds.setdefault(word, set()).add(kind)
    found = ahocorasick.Automaton()
    for word, of in kinds.items():
        found.add_word(word, (tuple(sorted(of)), len(word)))
    found.make_automaton()
    return found


def _letter(text: str, at: int) -> bool:
    """True if a letter of an alphabet, a digit or an underscore is there (not a Chinese character)."""
    return 0 <= at < len(text) and (text[at].isalnum() or text[at] == "_") and not "一" <= text[at] <= "鿿"


# ---------------------------------------------------------------- email

_LOCAL = frozenset("._%+-")
_LABEL = r"[A-Za-z0-9À-ÖØ-öø-ÿ](?:[A-Za-z0-9À-ÖØ-öø-ÿ\-]*[A-Za-z0-9À-ÖØ-öø-ÿ])?"
_DOT = r"(?:\.| ?[\(\[\{] ?(?:dot|DOT|Dot) ?[\)\]\}] ?)"
_DOMAIN = re.compile(rf"{_LABEL}(?:{_DOT}{_LABEL})+")
_SPOKEN = re.compile(rf"{_LABEL}(?: dot {_LABEL})+", re.I)


def _in_local(c: str) -> bool:
    return c in _LOCAL or (c.isalnum() and c <= "ÿ")


def _email(text: str, at: int, end: int) -> tuple[int, int] | None:
    """The address around the sign at ``at:end``: left while characters can belong, right by domain labels."""
    spoken = text[at:end].lower() == " at "
    left = at if spoken else at - (text[at - 1: at] == " " and text[at] in "([{")
    right = end + (text[end: end + 1] == " " and text[end - 1] in ")]}" and not spoken)
    domain = (_SPOKEN if spoken else _DOMAIN).match(text, right)
    if not domain or text[end: end + 1] == "@" or text[at - 1: at] == "@":
        return None
    start = left
    while start and _in_local(text[start - 1]):
        start -= 1
    while start < left and text[start] in _LOCAL:
        start += 1
    if text[start - 1: start] == "\\" and text[start: start + 1] in ("n", "r", "t"):  # an escape sequence before the address
        start += 1
    last = re.split(r"(?i)\.|[\(\[\{ ]dot[\)\]\} ]", domain.group())[-1].strip()
    if start >= left or not re.fullmatch(r"[A-Za-zÀ-ÿ]{2,}", last) or text[left - 1] in "._":
        return None
    return start, domain.end()


# ---------------------------------------------------------------- identity numbers

_SSN = re.compile(r"(\d{3})([- ])(\d{2})\2(\d{4})(?![A-Za-z0-9_]|[-./]\d)")
_NINO = re.compile(r"[A-Za-z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-Da-d](?![A-Za-z0-9])")
_PASSPORT = re.compile(r"(?:[A-Za-z]{1,2}\d{7,8}|[CFGHJKLMNPRTVWXYZcfghjklmnprtvwxyz](?=[A-Za-z0-9]*\d)[A-Za-z0-9]{8}|\d{9})(?![A-Za-z0-9_])")
_RESIDENT = re.compile(r"\d{6}((?:19|20)\d{2})(0[1-9]|1[0-2])(0[1-9]|[12]\d|3[01])\d{3}[\dXx](?![A-Za-z0-9])")
_TAX = re.compile(r"(?:\d{2} \d{3} \d{3} \d{3}|\d{11})(?![A-Za-z0-9_]|[.\-]\d)")
_OTHER_NUMBER = re.compile(r"(?:build|version|part|order|item|line|sku|model|release|rev|offset|range|chapter|case|lot|seq|serial|page|bestellung|zeile|teil|版本|编号|订单)(?: no\.?| number| #)?[ :#=]*\Z", re.I)
_FIRST_NUMBER = re.compile(r"[^\d\n.!?。！？]*?(?:\b(?:no|nr)\.[ ]?)?[^\d\n.!?。！？]*?(?=[A-Za-z]{0,2} ?\d)")
_FIRST_DIGIT = re.compile(r"[^\d\n.!?。！？]*?(?:\b(?:no|nr|tel)\.[ ]?)?[^\d\n.!?。！？]*?(?=[+(]?\(?\d)")


def resident_check(number: str) -> bool:
    """Check digit of an 18-character resident number (ISO 7064, modulus 11-2)."""
    total = sum(int(c) * pow(2, 17 - k, 11) for k, c in enumerate(number[:17]))
    return "10X98765432"[total % 11] == number[17].upper()


def tax_check(digits: str) -> bool:
    """Check digit and digit counts of an 11-digit tax number (ISO 7064, modulus 11, 10)."""
    product = 10
    for c in digits[:10]:
        product = ((int(c) + product) % 10 or 10) * 2 % 11
    counts = sorted(digits[:10].count(c) for c in set(digits[:10]))
    return digits[0] != "0" and (11 - product) % 10 == int(digits[10]) and counts[-1] in (2, 3) and counts[-2] == 1


def nino_prefix(prefix: str) -> bool:
    """True for prefixes that may be issued, and for the specimen prefix QQ."""
    p = prefix.upper()
    return p == "QQ" or not (p[0] in "DFIQUV" or p[1] in "DFIOQUV" or p in ("BG", "GB", "KN", "NK", "NT", "TN", "ZZ"))


def _ssn(text: str, at: int) -> tuple[int, int] | None:
    m = _SSN.match(text, at)
    if not m or _letter(text, at - 1) or text[at - 1: at] in (".", "-", "/"):
        return None
    before = " ".join(w for _, w in reversed(list(islice(_words_left(text, at - (text[at - 1: at] == " ")), 2))))
    bad = m.group(1) in ("000", "666") or m.group(3) == "00" or m.group(4) == "0000" or _OTHER_NUMBER.search(before)
    return None if bad else m.span()


def _nino(text: str, at: int, cued: bool) -> tuple[int, int] | None:
    """The insurance number whose six digits begin at ``at``."""
    start = at - 2 - (text[at - 1: at] == " ")
    m = _NINO.match(text, start) if start >= 0 else None
    if not m or _letter(text, start - 1) or not (cued or nino_prefix(text[start: start + 2])):
        return None
    return m.span()


def _resident(text: str, at: int) -> tuple[int, int] | None:
    m = _RESIDENT.match(text, at)
    return m.span() if m and not _letter(text, at - 1) and resident_check(m.group()) else None


def _taxrun(text: str, at: int) -> tuple[int, int] | None:
    m = _TAX.match(text, at)
    if not m or _letter(text, at - 1) or text[at - 1: at] in ("+", ".", "-", "/"):
        return None
    return m.span() if tax_check(m.group().replace(" ", "")) else None


def _after_cue(text: str, end: int, form: re.Pattern) -> tuple[int, int] | None:
    """The number of the given form that is the first number after a cue in its sentence or line."""
    reach = _FIRST_NUMBER.match(text, end)
    if not reach:
        return None
    for at in range(reach.end(), reach.end() + 4):  # up to two letters and a blank before the digits
        m = form.match(text, at)
        if m and not _letter(text, at - 1):
            return m.span()
    return None


# ---------------------------------------------------------------- telephone numbers

_PHONES = (
    r"\+1[ .\-]?(?:\(?[2-9]\d\d\)?)[ .\-]?[2-9]\d\d[ .\-]?\d{4}",
    r"(?:\+|00)(?!1[ .\-]?\()[1-9]\d{0,2}(?:[ .\-]?\(0\))?(?:[ .\-]?\d{1,11}){1,5}",
    r"(?:1[ .\-])?[2-9]\d\d(?:[.\-])[2-9]\d\d[.\-]\d{4}",
    r"(?:1[ .\-])?\([2-9]\d\d\)[ .\-]?[2-9]\d\d[ .\-]\d{4}",
    r"\(0\d{2,4}\)[ ]?\d{2,8}(?:[ \-]\d{2,8}){0,3}",
    r"0\d{2}[ \-/]\d{3,5}(?:[ \-]\d{3,5}){1,2}",
    r"0\d{3}[ \-]\d{3}[ \-]\d{3,4}",
    r"0\d{2,4}[ \-/]\d{6,8}",
    r"0[17]\d{3}[ \-]\d{3}[ \-]?\d{3}",
    r"1[3-9]\d[ \-]\d{4}[ \-]\d{4}",
)
_TAIL = r"(?![\d]|[.\-/_]\d|[A-Za-z_])"
_PHONE = re.compile("(?:" + "|".join(f"(?:{p})" for p in _PHONES) + ")" + _TAIL)
# Written without separators or with blanks only, a number needs a cue.
_PHONE_CUED = re.compile("(?:" + "|".join(f"(?:{p})" for p in (*_PHONES, r"1[3-9]\d{9}", r"0\d{8,11}", r"[2-9]\d\d ?[2-9]\d\d ?\d{4}")) + ")" + _TAIL)
_BEFORE_PHONE = frozenset("_+.-/@#(")


def _phone_ok(piece: str) -> bool:
    digits = sum(c.isdigit() for c in piece)
    if piece[0] == "+" or piece.startswith("00"):
        return 9 <= digits <= 16
    return 9 <= digits <= 12 and not re.fullmatch(r"\d{2} \d{3} \d{3} \d{3}", piece)


def _phone(text: str, at: int, form: re.Pattern = _PHONE) -> tuple[int, int] | None:
    """The number that begins at ``at``."""
    before = text[at - 1: at]
    if before and (before in _BEFORE_PHONE or _letter(text, at - 1)):
        return None
    m = form.match(text, at)
    return m.span() if m and _phone_ok(m.group()) else None


# ---------------------------------------------------------------- addresses

_DIRECTION = re.compile(r"(?:north|south|east|west|[nsew])\.?\Z", re.I)
_HOUSE = re.compile(r"(?:.*[^\w.\-])?(\d{1,5}[A-Za-z]?)\Z", re.S)
_DE_NUMBER = re.compile(r" \d{1,4} ?[a-zA-Z]?(?![A-Za-z0-9_äöüß])|(?<=\.)\d{1,4} ?[a-zA-Z]?(?![A-Za-z0-9_äöüß])")
_DE_WORD = re.compile(r"[A-ZÄÖÜ][a-zäöüß]+(?:[- ][A-ZÄÖÜ][a-zäöüß]+)*")
_ZH_NUMBER = re.compile(r" ?\d{1,5} ?号")
_NO_STREET_DE = frozenset("januar februar märz april mai juni juli august september oktober november dezember montag dienstag mittwoch donnerstag freitag samstag sonntag jahr ende anfang tag abschnitt kapitel".split())


def _words_left(text: str, at: int) -> Iterator[tuple[int, str]]:
    """(start, word) of the words before ``at``, nearest first, that single blanks separate."""
    while at > 0 and text[at - 1] not in " \n\r\t":
        start = at
        while start and text[start - 1] not in " \n\r\t":
            start -= 1
        yield start, text[start:at]
        if text[start - 1: start] != " ":
            return
        at = start - 1


def _street_en(text: str, at: int, end: int) -> tuple[int, int] | None:
    """House number, direction and one to three street words before the street type at ``at:end``."""
    if _letter(text, end) or text[at + 1: at + 2].islower():
        return None
    big = text[at + 1: end].isupper()
    named, turned = 0, False
    for start, word in _words_left(text, at):
        street = re.fullmatch(r"[A-Z][A-Z'’\-]+" if big else r"[A-Z][a-zà-ÿ'’\-]+|\d+(?:st|nd|rd|th)", word)
        house = _HOUSE.match(word)
        if named and _DIRECTION.match(word) and word[0].isupper() and not turned:
            turned = True
        elif named and house and not re.fullmatch(r"\d+(?:st|nd|rd|th)", word):
            first = start + house.start(1)
            return None if _letter(text, first - 1) else (first, end)
        elif street and not turned and named < 3:
            named += 1
        elif named and (m := re.search(r"(?:[^\w.\-]|[一-鿿])(\d{1,5}[A-Za-z]?)\Z", word)):
            return start + m.start(1), end
        else:
            return None
    return None


def _street_de(text: str, at: int, end: int) -> tuple[int, int] | None:
    """The street name that ends with the word at ``at:end``, with the number behind it."""
    number = _DE_NUMBER.match(text, end)
    if not number:
        return None
    start = at
    while start and (text[start - 1].isalpha() or text[start - 1] == "-"):
        start -= 1
    if start == at or text[start - 1: start] == " " and text[start].isupper() and text[at].isupper():  # a word of its own
        for first, word in _words_left(text, start - 1):
            if re.fullmatch(r"[A-ZÄÖÜ][a-zäöüß]+(?:-[A-ZÄÖÜ][a-zäöüß]+)*", word) and word.lower() not in NOT_NAMES:
                return first, number.end()
            break
        if start == at:
            return None
    while start < at and not text[start].isascii() and "一" <= text[start] <= "鿿":
        start += 1
    name = text[start:at]
    ok = re.fullmatch(r"[A-ZÄÖÜ][a-zäöüß]+(?:-[A-ZÄÖÜ]?[a-zäöüß]*)*", name) and not _letter(text, start - 1)
    return (start, number.end()) if ok else None


def _street_de_before(text: str, at: int, end: int) -> tuple[int, int] | None:
    """A name after a capitalised preposition at ``at:end`` and the number behind it."""
    m = _DE_WORD.match(text, end)
    if not m or not text[at].isupper() or _letter(text, at - 1) or m.group().split()[-1].lower() in _NO_STREET_DE:
        return None
    number = _DE_NUMBER.match(text, m.end())
    return (at, number.end()) if number else None


def _street_zh(text: str, at: int, end: int) -> tuple[int, int] | None:
    """The characters before the street word back to a place or a verb, and the number behind it."""
    number = _ZH_NUMBER.match(text, end)
    start = at
    while start and "一" <= text[start - 1] <= "鿿" and text[start - 1] not in ZH_BEFORE_ADDRESS:
        start -= 1
    return (start, number.end()) if number and start < at else None


# ---------------------------------------------------------------- names

_UP = "A-ZÀ-ÖØ-Þ"
_LO = "a-zß-öø-ÿ"
_CAP = rf"(?:[OD]['’])?(?:Mc|Mac)?[{_UP}][{_LO}]+(?:[-'’](?!s\b)[{_UP}][{_LO}]+)*"
_BIG = rf"(?:O['’]|MC)?[{_UP}]{{2,}}(?:-[{_UP}]{{2,}})*"
_SMALL = rf"(?:o['’])?[{_LO}]{{2,}}(?:-[{_LO}]{{2,}})*"
_PARTICLE = r"(?:(?:von|van|de|der|den|del|della|di|da|la|le|zu|ter|bin|al) ){0,2}"


def _shape(word: str, initial: str) -> str:
    return rf"(?:{word}, {word}(?: {initial})?|{word}, {initial}|{word}(?: {initial}){{0,2}} {_PARTICLE}{word}|{initial}(?: ?{initial})? ?{_PARTICLE}{word})"


_END = rf"(?![{_LO}{_UP}0-9_])"
_FORWARD = tuple(re.compile(f"{_shape(w, i)}{_END}") for w, i in ((_CAP, rf"[{_UP}]\."), (_BIG, rf"[{_UP}]\."), (_SMALL, rf"[{_LO}]\.")))
_SINGLE = re.compile(f"{_CAP}{_END}")
_WORD = re.compile(r"[^\W\d_]+")
_WORD_ZH = re.compile(r"[一-鿿]+")
_CLAUSE = re.compile(r"(?:^|[\n\r>*\"“(\-–|]|[.!?:,;。！？：，；])\s*\Z")
_NAME_END = re.compile(r"(?:'s|’s)?(?:[\s.,;:!?)\]\"”。，；\\]|\Z|[一-鿿])")
_COMMON = frozenset(GIVEN_NAMES)


def _plausible(piece: str) -> bool:
    return not any(w in NOT_NAMES for w in re.split(r"[ ,]+", piece.lower()) if len(w) > 2 or not w.endswith("."))


def _name_form(text: str, at: int, weak: bool = False) -> tuple[int, int, int] | None:
    """(start, end, 2 capitalised or 1 lower-case) of the name that begins at ``at``; beside a ``weak`` cue a
    lower-case name needs an initial or a common given name."""
    if not text[at: at + 1].isalpha() or _letter(text, at - 1):
        return None
    small = text[at].islower()
    if small and weak and text[at + 1: at + 2] != "." and _WORD.match(text, at).group() not in _COMMON:
        return None
    for k, form in ((2, _FORWARD[2]),) if small and text[at + 1: at + 2] not in "'’" else enumerate(_FORWARD):
        m = form.match(text, at)
        if m and _plausible(m.group()):
            return at, m.end(), 2 if k < 2 else 1
    return None


def _evidence_inside(piece: str) -> int:
    """Evidence of the words themselves: a common given name, or an initial before the family name."""
    words = re.split(r"[ ,]+", piece.lower())
    given = 2 if any(w in _COMMON for w in (words[0], words[-1] if "," in piece else words[0], words[1] if "," in piece else words[0])) else 0
    return max(given, 1 if re.match(r"\S\.", piece) else 0)


def _left_starts(text: str, end: int) -> list[int]:
    """Starts of up to five words before ``end`` from which a name could run up to it, farthest first."""
    out = []
    for start, word in _words_left(text, end):
        lead = re.search(r"[^\w.'’,\-]+(?=[^\W\d]*\S*\Z)", word)  # a quote, a bracket or a sign before the word
        cut = start + (lead.end() if lead else 0)
        zh = max((k for k, c in enumerate(text[cut:end]) if "一" <= c <= "鿿"), default=-1)
        out.append(cut + zh + 1)
        if len(out) == 5 or lead or zh >= 0:
            break
    return out[::-1]


def _names(text: str, hits: dict[str, list[tuple[int, int]]]) -> list[tuple[int, int, int]]:
    """(start, end, evidence) of the candidates with enough evidence."""
    seen: dict[tuple[int, int], dict[str, int]] = {}

    def note(span: tuple[int, int] | None, what: str, score: int) -> None:
        if span:
            found = seen.setdefault(span[:2], {})
            found[what] = max(found.get(what, 0), score)

    for a, b in hits.get("given", ()):
        if not _letter(text, a - 1) and not _letter(text, b):
            note(_name_form(text, a), "in", 0)
            if text[a - 2: a] == ", ":  # family name first
                for start in _left_starts(text, a - 2)[-1:]:
                    form = _name_form(text, start)
                    note(form if form and form[1] >= b else None, "in", 0)
    for kind, score in (("title", 2), ("label", 2), ("ask", 2), ("weak", 1)):
        for a, b in hits.get(kind, ()):
            if _letter(text, a - 1):
                continue
            at = b + (text[b: b + 1] == " ") if kind == "label" else b
            form = _name_form(text, at, kind == "weak")
            note(form, "before", score)
            if kind == "title" and not form and (m := _SINGLE.match(text, at)) and _plausible(m.group()) and text[a].isupper():
                note(m.span(), "before", 2)
    for kind, score in (("says", 2), ("weak_after", 1)):
        for a, b in hits.get(kind, ()):
            if kind == "says" and _letter(text, b):
                continue
            for start in _left_starts(text, a):
                form = _name_form(text, start, kind == "weak_after")
                if form and form[1] == a:
                    note(form, "after", score)
                    break
    for kind in ("zh_before", "zh_label"):  # a name in Latin letters inside Chinese text
        for _, b in hits.get(kind, ()):
            at = b + (text[b: b + 1] in (":", "：", " ")) if kind == "zh_label" else b + (text[b: b + 1] == " ")
            note(_name_form(text, at + (text[at: at + 1] == " ")), "before", 2)
    for a, _ in hits.get("zh_after", ()):
        end = a - (text[a - 1: a] == " ")
        for start in _left_starts(text, end) if end else ():
            form = _name_form(text, start)
            if form and form[1] == end:
                note(form, "after", 2)
                break
    out = []
    for (a, b), why in seen.items():
        piece = text[a:b]
        inside = _evidence_inside(piece)
        small = piece == piece.lower()
        if small:
            inside = min(inside, 1)
            if not _NAME_END.match(text, b) and "after" not in why:
                continue
        clause = 1 if _CLAUSE.search(text[max(0, a - 4): a]) else 0
        context = why.get("before", 0) + why.get("after", 0)
        if small:
            enough = inside and context + clause or why.get("before", 0) == 2 and (why.get("after") or re.match(r"[\n\r)\"”]|\Z|\\n", text[b:b + 2]))
        else:
            enough = inside + context + clause >= 2 and (inside or context)
        if enough:
            out.append((a, b, inside + context + clause))
    return sorted(out, key=lambda x: (-x[2], x[0], -x[1]))


def _surname_zh(text: str, at: int) -> int:
    """Length of the family name that begins at ``at``, 0 if there is none."""
    return 2 if text[at: at + 2] in LONG_SURNAMES_ZH else 1 if text[at: at + 1] and text[at] in SURNAMES_ZH else 0


def _names_zh(text: str, hits: dict[str, list[tuple[int, int]]]) -> Iterator[tuple[int, int]]:
    """Names of a family name and one or two characters, after a label or preposition or before a verb."""
    afters = {a for a, _ in hits.get("zh_after", ())}
    befores = {b for _, b in hits.get("zh_before", ())}
    ends = lambda at: at in afters or text[at: at + 1] == " " or not _WORD_ZH.match(text, at)
    for kind in ("zh_label", "zh_before"):
        for _, b in hits.get(kind, ()):
            at = b
            while text[at: at + 1] in (":", "：", " "):
                at += 1
            family = _surname_zh(text, at)
            for given in (2, 1) if family else ():
                end = at + family + given
                run = _WORD_ZH.match(text, at)
                if run.end() >= end and ends(end) and text[at: at + 2] not in NOT_NAMES_ZH:
                    yield at, end
                    break
    for a in afters:
        end = a - (text[a - 1: a] == " ")
        for given in (2, 1):
            for family in (2, 1):
                start = end - family - given
                if start >= 0 and _surname_zh(text, start) == family and text[start: start + 2] not in NOT_NAMES_ZH and _WORD_ZH.fullmatch(text, start, end):
                    if not _WORD_ZH.match(text, start - 1) or start in befores or start == 0:
                        yield start, end


# ---------------------------------------------------------------- one text


class _Claims:
    """Disjoint spans; a later one that meets an earlier one is refused."""

    def __init__(self):
        self.starts: list[int] = []
        self.spans: list[tuple[int, int, str]] = []

    def add(self, span: tuple | None, kind: str) -> None:
        if not span:
            return
        a, b = span[:2]
        at = bisect_left(self.starts, a)
        if (at and self.spans[at - 1][1] > a) or (at < len(self.starts) and self.starts[at] < b):
            return
        self.starts.insert(at, a)
        self.spans.insert(at, (a, b, kind))


def pieces(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, type) of all personal information in ``text``, in order, without overlaps."""
    if not text:
        return []
    flat = text.translate(_WIDE)
    hits: dict[str, list[tuple[int, int]]] = {}
    for last, (kinds, size) in _anchors().iter(flat.translate(_SHAPE)):
        for kind in kinds:
            hits.setdefault(kind, []).append((last + 1 - size, last + 1))
    taken = _Claims()
    for a, b in hits.get("email", ()):
        taken.add(_email(flat, a, b), "email")
    for a, _ in hits.get("resident", ()):
        taken.add(_resident(flat, a), "identity")
    cued = set()
    for kind, form in (("national", _NINO), ("pass", _PASSPORT), ("tax", _TAX)):
        for a, b in hits.get(kind, ()):
            if not _letter(flat, a - 1):
                span = _after_cue(flat, b, form)
                taken.add(span, "identity")
                cued.add(span)
    for a, _ in hits.get("nino", ()):
        taken.add(_nino(flat, a, False), "identity")
    for a, _ in hits.get("ssn", ()):
        taken.add(_ssn(flat, a), "identity")
    for a, _ in hits.get("taxrun", ()):
        taken.add(_taxrun(flat, a), "identity")
    for a, _ in hits.get("phone", ()):
        taken.add(_phone(flat, a), "phone")
    for a, b in hits.get("call", ()):
        reach = _FIRST_DIGIT.match(flat, b)
        if reach and not _letter(flat, a - 1):
            taken.add(_phone(flat, reach.end(), _PHONE_CUED), "phone")
    for kind, parser in (("en", _street_en), ("de", _street_de), ("de_before", _street_de_before), ("zh", _street_zh)):
        for a, b in hits.get(kind, ()):
            taken.add(parser(flat, a, b), "address")
    for a, b, _ in _names(flat, hits):
        taken.add((a, b), "name")
    if "zh_label" in hits or "zh_before" in hits or "zh_after" in hits:
        for span in _names_zh(flat, hits):
            taken.add(span, "name")
    return taken.spans


def redact(text: str | None) -> str | None:
    """``text`` with each piece replaced by the placeholder of its type; all else unchanged."""
    if not text:
        return text
    out, at = [], 0
    for start, end, kind in pieces(text):
        out += [text[at:start], PLACEHOLDERS[kind]]
        at = end
    return "".join([*out, text[at:]])


# ---------------------------------------------------------------- tables


def _found_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, kinds, texts = [], [], []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for kind, piece in sorted({(k, text[a:b]) for a, b, k in pieces(text)}):
                ids.append(doc)
                kinds.append(kind)
                texts.append(piece)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(kinds, pa.string()), pa.array(texts, pa.string())], ["doc_id", "pii_type", "found_text"])


def found(documents: DataFrame) -> DataFrame:
    """(doc_id, pii_type, found_text): every piece once per document. No shuffle unless doc_ids repeat rows."""
    return documents.select("doc_id", "text").where("text is not null").mapInArrow(
        _found_batches, "doc_id long, pii_type string, found_text string"
    )


def _redact_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [redact(t) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])


def redacted(documents: DataFrame) -> DataFrame:
    """(doc_id, text) with all personal information replaced."""
    return documents.select("doc_id", "text").mapInArrow(_redact_batches, "doc_id long, text string")
