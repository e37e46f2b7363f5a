"""Personal information in free text: finding it, and replacing it with typed placeholders.

Regular expressions propose spans of five kinds (email, phone, id_number,
address, name); checksums and number plans confirm or refute them; words close
by raise or lower their score. Spans that reach the threshold are kept, the
stronger of two that overlap. Names are proposed by the words around a person
(greetings, titles, roles, fields of records) and have to look like a name.

Texts are scanned in the tasks that read them; only spans leave a scan for
``found``, only the masked text for ``masked``, and nothing is shuffled. One
pass of an automaton finds which patterns can match a text at all: each pattern
is tried if what every match of it has to hold is there, so none is missed.
Full-width letters, digits and signs are read as their plain forms, one for
one, so that positions stay those of the text.

Defined cases: null and empty texts have no span and stay as they are; positions count
code points from 1; rows stored twice are found twice; texts of any length are
scanned whole; masking a masked text changes nothing.
"""

from __future__ import annotations

import datetime
import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.llm.batches import slices
from fathomline.session import spread

KINDS = ("email", "phone", "id_number", "address", "name")
PLACEHOLDERS = {k: f"<{k.upper()}>" for k in KINDS}
THRESHOLD = 0.5

#: Full-width forms are read as the plain characters 0xFEE0 below them.
_WIDE = {c: c - 0xFEE0 for c in (*range(0xFF10, 0xFF1A), *range(0xFF21, 0xFF3B), *range(0xFF41, 0xFF5B))}
_WIDE |= {ord(wide): plain for wide, plain in zip("＠＋－．（）＿", "@+-.()_", strict=True)}
_WIDE[0x3000] = " "

# --- checksums ---------------------------------------------------------------


def _digits(s: str) -> list[int]:
    return [int(c) for c in s if c.isdigit()]


def luhn(s: str) -> bool:
    """The Luhn check of payment cards and social insurance numbers."""
    d = _digits(s)[::-1]
    return len(d) > 1 and sum(d[::2] + [x * 2 - 9 * (x > 4) for x in d[1::2]]) % 10 == 0


def mod_11_2(s: str) -> bool:
    """ISO 7064 mod 11-2 with a valid date in places 7 to 14: the 18-digit resident identity number."""
    s = re.sub(r"[ -]", "", s).upper()
    try:
        datetime.date(int(s[6:10]), int(s[10:12]), int(s[12:14]))
    except ValueError:
        return False
    if not 1880 <= int(s[6:10]) <= 2100:
        return False
    total = 0
    for c in s:
        total = (total * 2 + (10 if c == "X" else int(c))) % 11
    return total == 1


def mod_11_10(s: str) -> bool:
    """ISO 7064 mod 11,10: the 11-digit tax number."""
    product = 10
    d = _digits(s)
    for x in d[:-1]:
        product = ((product + x) % 10 or 10) * 2 % 11
    return len(d) == 11 and (11 - product) % 10 == d[-1]


def iban(s: str) -> bool:
    """ISO 7064 mod 97-10 with the first four characters moved behind: account numbers of many countries."""
    s = re.sub(r"[ -]", "", s).upper()
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def mod_97(s: str) -> bool:
    """The 15-digit social security number whose last two digits complete 97."""
    s = re.sub(r"[ .-]", "", s).upper().replace("2A", "19").replace("2B", "18")
    return len(s) == 15 and s.isdigit() and 97 - int(s[:13]) % 97 == int(s[13:])


def mod_23(s: str) -> bool:
    """Eight digits with the control letter of their remainder by 23 (fixed value)."""
    s = re.sub(r"[ -]", "", s).upper()
    return "TRWAGMYFPDXBNJZSQVHLCKE"[int(s[:8]) % 23] == s[8]


# --- proposals ---------------------------------------------------------------

_LEFT, _RIGHT = r"(?<![0-9A-Za-z_])(?<![0-9][-./:])", r"(?![0-9A-Za-z_]|[-./:][0-9])"

_LOCAL = r"[A-Za-z0-9À-ÖØ-öø-ÿ_](?:[A-Za-z0-9À-ÖØ-öø-ÿ_.+-]*[A-Za-z0-9À-ÖØ-öø-ÿ_+-])?"
_DOT = r"(?:\.| ?[\[(] ?dot ?[\])] ?| dot )"
_HOST = rf"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:{_DOT}[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)*{_DOT}[A-Za-z]{{2,}}"
EMAIL = re.compile(
    rf"(?<![A-Za-z0-9_.+%À-ÖØ-öø-ÿ-]){_LOCAL}(?: ?@ ?|%40| ?[\[(] ?at ?[\])] ?| at (?=[A-Za-z0-9.-]+ dot )){_HOST}", re.I
)

_NUMBER_WORD = "zero|oh|one|two|three|four|five|six|seven|eight|nine"
PHONE = re.compile(
    rf"{_LEFT}(?:"
    r"\(\+[0-9]{1,3}\)[ -]?[0-9][0-9 -]{6,13}[0-9]"
    r"|\+[0-9]{1,3}[ -]?\([0-9]{1,5}\)[ -]?[0-9](?:[ -]?[0-9]){4,12}"
    r"|\+[0-9]{1,3}[ -]?[0-9](?:[ -]?[0-9]){6,12}"
    r"|00[1-9][0-9][ -]1[3-9][0-9](?:[ -]?[0-9]){8}"
    r"|1[3-9][0-9]([ -]?)[0-9]{4}\1[0-9]{4}"
    r"|(?:1[-. ])?(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}([-. ]))[0-9]{3}(?(2)\2|[-. ])[0-9]{4}"
    r"|1?[2-9][0-9]{9}"
    r"|\(0[0-9]{2,4}\)[ ]?[0-9]{4,8}(?:[ -][0-9]{1,4})?"
    r"|0[0-9]{2,4}[-/][0-9]{4,8}(?:[ -][0-9]{1,4})?"
    r"|0[0-9]{2,3}[ ][0-9]{7,8}|0[0-9]{2}[ ][0-9]{4}[ ][0-9]{4}|0[0-9]{2}[ ][0-9]{5}[ -][0-9]{3}"
    r"|07[0-9]{3}[ ]?[0-9]{6}"
    r"|0[1-9](?:([. -]?)[0-9]{2})(?:\3[0-9]{2}){3}"
    r"|[6789][0-9]{2}([ -]?)[0-9]{3}\4[0-9]{3}|[6789][0-9]{2}([ -])[0-9]{2}\5[0-9]{4}|[6789][0-9]{2}(?:[ -][0-9]{2}){3}"
    rf"|(?:{_NUMBER_WORD})(?:[ -](?:{_NUMBER_WORD})){{6,14}}"
    r"|[零〇一二三四五六七八九幺]{7,12}"
    rf"){_RIGHT}",
    re.I,
)
_IDS = (
    # pattern, score, check, what it adds if it holds; without it only words close by make a number an identity
    (r"[0-9]{6}([ -]?)(?:18|19|20)[0-9]{6}\1[0-9]{3}[0-9X]", 0.1, mod_11_2, 0.7),
    (r"[12][ ]?[0-9]{2}[ ]?[0-9]{2}[ ]?(?:[0-9]{2}|2[AB])[ ]?[0-9]{3}[ ]?[0-9]{3}[ ]?[0-9]{2}", 0.1, mod_97, 0.4),
    (r"[0-9]{2}[ ]?[0-9]{3}[ ]?[0-9]{3}[ ]?[0-9]{3}", 0.0, mod_11_10, 0.2),
    (r"[0-9]{8}[ -]?[A-HJ-NP-TV-Z]", 0.1, mod_23, 0.3),
    (r"[A-Z]{2}[ ]?[0-9]{2}[ ]?[0-9]{2}[ ]?[0-9]{2}[ ]?[A-D]", 0.5, None, 0.0),
    (r"[A-Z]{1,2}[0-9]{7,8}", 0.15, None, 0.0),
    (r"[0-9]{3}-[0-9]{2}-[0-9]{4}", 0.45, None, 0.0),
    (r"(?<![0-9] )[0-9]{3}([ -])[0-9]{3}\1[0-9]{3}(?! [0-9])", 0.0, luhn, 0.2),
    (r"[0-9]{3}([ ]?)[0-9]{2}\1[0-9]{4}", 0.15, None, 0.0),
    # accounts and cards: the check decides for grouped ones, words close by for the others
    (r"[A-Z]{2}[0-9]{2}(?:[ ]?[0-9A-Z]{4}){1,2}(?:[ ]?[0-9]{4}){2,4}(?:[ ]?[0-9A-Z]{1,4})?", 0.0, iban, 0.6),
    (r"[3-6][0-9]{3}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?:\1[0-9]{1,3})?|3[47][0-9]{2}([ -])[0-9]{6}\2[0-9]{5}", 0.0, luhn, 0.55),
    (r"[3-6][0-9]{12,18}", -0.3, luhn, 0.3),
)
IDS = tuple((re.compile(rf"{_LEFT}{p}{_RIGHT}", re.I), *rest) for p, *rest in _IDS)

_W = r"[^\W\d_][\w'’-]*"
_STREET = (
    "lane|road|rd|row|street|st|ave|avenue|blvd|boulevard|terrace|drive|court|way|close|square|crescent|mews|parade|hill|grove"
)
_HAN = "一-鿿"
_ADDRESSES = (
    # postal boxes, and house number before or behind the street, in the orders of several countries
    (r"(?:P\.? ?O\.? Box|Postfach|BP|Apartado)[ ][0-9]+(?:,? [^\W\d_][\w'’-]+(?: [^\W\d_][\w'’-]+)? [0-9]{4,6}|,? [0-9]{4,6} [^\W\d_][\w'’-]+)?", 0.6),
    (
        rf"(?:(?:flat|apt|apartment|unit|suite)\.? [0-9]+\w?, )?[0-9]+(?:-[0-9]+)?[a-z]?,? (?:[NSEW]\. )?(?:{_W} ){{1,3}}(?:{_STREET})\b(?:(?<=ave|lvd)\.|(?<=st|rd)\.(?=[ ,]))?"
        rf"(?:,? (?:suite|apt|apartment|unit|flat|floor)\.? ?[0-9]+\w?)?(?:, {_W}(?: {_W})?, [A-Z]{{2}} [0-9]{{4,6}}|, {_W}(?= and|, ask|\.|,|$))?",
        0.45,
    ),
    (
        rf"(?:(?:(?:am|an der|an den|auf dem|auf der|im|in der|zum|zur|unter den) (?:{_W} )?)?[^\W\d_]+(?:straße|strasse|str\.|weg|gasse|allee|platz|ufer|ring|damm|steig|pfad))"
        rf" [0-9]+(?:[/-][0-9]+)?[a-z]?\b(?:, (?:hinterhaus|vorderhaus|seitenflügel|[0-9]+\. ?(?:og|stock)))?(?:, [0-9]{{5}} {_W}(?: {_W})?)?",
        0.45,
    ),
    (
        rf"[0-9]+(?: ?(?:bis|ter|quater))?,? (?:rue|avenue|av\.|impasse|boulevard|bd|place|chemin|allée|quai|route|cours|passage|square|sentier) {_W}(?: {_W}){{0,4}}"
        rf"(?:, (?:bât|bâtiment|apt|appt|étage)\.? ?\w+)?(?:, [0-9]{{5}} {_W})?",
        0.5,
    ),
    (
        rf"(?:calle|c/|avda\.?|av\.|avenida|plaza|pza\.?|paseo|camino|ronda|travesía|carrera|glorieta) {_W}(?: {_W}){{0,4}}(?: ?, ?| )(?:n\.?º ?)?[0-9]+(?:, ?[0-9]+ ?º(?: ?[A-Z]\b)?)?(?:, [0-9]{{5}} {_W})?",
        0.5,
    ),
)
ADDRESSES = tuple((re.compile(rf"(?<![\w=.-])(?:{p})", re.I), s) for p, s in _ADDRESSES)
_HAN_HOUSE = re.compile(r"[0-9](?:号|组|弄)")
_AREA = rf"(?:[{_HAN}]{{2,4}}?(?:省|自治区))?(?:[{_HAN}]{{2,4}}?[市县州])?(?:[{_HAN}]{{2,4}}?[区镇乡县])?"
_HOUSE = rf"(?:[0-9]+|[{_HAN}]{{2,4}}?(?:大厦|小区|广场|花园|公寓|院))?(?:(?:[0-9]+|[A-Z])(?:号院|号楼|号|弄|组|单元|栋|幢|座|层|室|楼|房)?)*"
_ROAD = rf"[{_HAN}]{{2,4}}?(?:大道|路|街|巷|胡同|村|弄)"
ADDRESS_HAN = re.compile(
    r"(?P<cue>寄到|寄往|送到|送往|装在|住在|住址[：: ]?|地址[：: 是为]?|位于|搬到|地点[：: ]?|发往|在|到|至|[^\w]|^)"
    rf"(?P<span>{_AREA}{_ROAD}[0-9]+(?:号院|号楼|号|弄|组)"
    rf"(?:[{_HAN}]{{2,4}}?(?:大厦|小区|广场|花园|公寓))?(?:[0-9A-Z]+(?:号院|号楼|号|单元|栋|幢|座|层|室|楼|房))*(?:(?<=层)[0-9]+)?)"
)

# --- names -------------------------------------------------------------------

_LETTER = rf"[^\W\d_{_HAN}]"
_PART = rf"{_LETTER}(?:{_LETTER}|['’](?={_LETTER})|-(?={_LETTER})){{1,}}"
_INITIAL = rf"{_LETTER}\."
_PARTICLES = ("van", "der", "den", "de", "del", "della", "di", "du", "la", "le", "von", "zu", "zum", "ten", "ter", "da", "dos")
_TAIL = rf"(?:(?:{'|'.join(_PARTICLES)}) ){{0,3}}{_PART}"
#: "Family, Given", "Given M. Family" or "G. Family", each with particles.
_LATIN = rf"(?:{_TAIL}, (?:{_PART}|{_INITIAL})|(?:{_PART}|{_INITIAL}) (?:{_INITIAL} )?{_TAIL})"
_HAN_NAME = rf"[{_HAN}]{{2,4}}?"
_NAME = rf"(?P<name>{_LATIN}|{_HAN_NAME})"
#: The most frequent family names of one character (fixed values).
_FAMILY = "王李张刘陈杨黄赵吴周徐孙马朱胡郭何高林罗郑梁谢宋唐许韩冯邓曹彭曾肖田董潘袁蔡蒋余于杜叶程魏苏吕丁任卢姚沈钟姜崔谭陆范汪廖石金韦贾夏付方邹熊白孟秦邱侯江尹薛闫段雷龙黎史陶贺毛郝顾龚邵万覃武钱戴严莫孔向常汤"
_TITLES = r"(?:dr|prof|mr|mrs|ms|mme|mlle|m|ing|sr|sra|herr|frau|monsieur|madame|señora?|don|doña)"
_END = r"(?=[.!]?(?:\s|$)|[。，！\n])"
_GATED_TITLES = tuple(
    f"{t}{dot} "
    for t in ("dr", "prof", "mr", "mrs", "ms", "mme", "mlle", "sr", "sra", "herr", "frau", "monsieur", "madame", "señor", "señora", "doña")
    for dot in ("", ".")
)
#: Literals to look for first, the words before a name, what follows it, and the score they give.
CUE_RULES = (
    (("this is ",), r"\bthis is (?:TITLE\b\.? )?", r"(?= (?:from|of|at|in|on|here|speaking|with)\b|[.,!])", 0.5),
    (("ask ",), r"\bask (?:TITLE\b\.? )?", r"(?= (?:for|about|to|if|whether|when|where)\b|[.,])", 0.5),
    ((", or ",), r"\bask [^.\n]{0,8}[^\n]{3,90}?, or (?:TITLE\b\.? )?", r"(?=[.,;!?\n]|$)", 0.5),
    (
        _GATED_TITLES,
        r"(?<![\w.-])(?:dr|prof|mr|mrs|ms|mme|mlle|sra?|herr|frau|monsieur|madame|señora?|doña)\b\.? ",
        r"(?=\W|$)",
        0.4,
    ),
    (
        ("thx", "thanks", "regards", "cheers", "sincerely"),
        r"\b(?:thx|thanks|regards|cheers|sincerely)[,!]?\s{1,2}",
        r"(?=[.!]?(?:\s|$)|[。，！\n])",
        0.35,
    ),
    (
        ("gruß", "gruss", "grüße", "mfg", "merci", "cordialement", "saludo", "abraço", "groet"),
        r"\b(?:gruß|gruss|grüße|mfg|merci|cordialement|saludos?|abraços?|groet|groeten)[,!]\s{1,2}",
        r"(?=[.!]?(?:\s|$)|[。，！\n])",
        0.45,
    ),
    (
        ("user ", "customer ", "employee ", "colleague ", "caller ", "operator ", "engineer "),
        r"\b(?:user|customer|employee|colleague|caller|operator|engineer) (?:TITLE\b\.? )?",
        r"(?= ?\(| ?<[^A-Z]| (?:reported|reports|said|says|called|wrote|asked|opened|cannot|can't|could|has|had|is|was)\b)",
        0.5,
    ),
    (("to:", "attn:"), r"\b(?:to|attn): ?(?:TITLE\b\.? )?", r"(?=, )", 0.5),
    (("geht an ", "sendet an ", "liefert an "), r"\b(?:geht|sendet|liefert) an (?:TITLE\b\.? )?", r"(?=, |\.)", 0.5),
    (
        ('name"', 'contact"', 'person"', 'owner"', 'recipient"', 'assignee"'),
        r"\"(?:contact|name|full_?name|person|owner|user_?name|recipient|assignee)\" ?: ?\"",
        r"(?=\")",
        0.5,
    ),
    (("|",), r"\| ?", r"(?= ?\| ?[+(0-9a-z][^|\n]{5,60}\|)", 0.45),
    (
        ("收件人", "请找", "联系人", "值班的", "负责人", "签收人", "姓名", "申请人", "经办人"),
        r"(?:收件人|请找|联系人|值班的|负责人|签收人|姓名|申请人|经办人)[：:】 是为]{0,2}",
        r"(?=[，。、；！【（(\"\s]|确认|处理|核实|跟进|$)",
        0.6,
    ),
    (
        ("meet ", "met ", "met with ", "contact ", "call ", "email ", "ping ", "invite ", "thank "),
        r"\b(?:meet|met|met with|contact|call|email|ping|invite|thank) (?:TITLE\b\.? )?",
        r"(?= (?:at|on|by|in|from|about|for|after|before|tomorrow|today)\b|[.,;!?\n]|$)",
        0.2,
    ),
    (
        (" called", " reported", " says", " said", " asked", " wrote", " mentioned", " noticed", " complained", " phoned", " emailed"),
        r"(?:^|[.!?]\s|\n)",
        r"(?= (?:called|reported|says|said|asked|wrote|mentioned|noticed|complained|phoned|emailed)\b)",
        0.2,
    ),
    (
        ("反馈", "反映", "投诉", "表示", "来电", "提到"),
        rf"(?<![{_HAN}])(?=[{_FAMILY}])",
        r"(?=反馈|反映|投诉|表示|来电|提到)",
        0.4,
    ),
    (("用户", "客户", "同事"), r"(?:用户|客户|同事)", r"(?=反馈|反映|报告|投诉|表示|来电|提到|多次|遇到|无法|说|登录)", 0.6),
)
CUES = tuple(
    (re.compile(cue.replace("TITLE", _TITLES) + _NAME + after, re.I | re.M), score) for _, cue, after, score in CUE_RULES
)
#: Lists of people after a role.
NAME_LIST = re.compile(r"(?:审批人|参与人|抄送人|值班人|参会人)[：: ]{0,2}(?P<list>[^，。；！\n]{2,120})")
#: Words behind a person.
BEHIND = re.compile(
    r" (?:signed off on|(?:approved|acknowledged|confirmed) the|hat die Freigabe|a validé|aprobó)\b"
    r"|(?:老师|先生|女士|同学|经理|工程师|师傅|主任)(?:说|认为|建议|反馈|表示|觉得|确认|提到|，)",
    re.I,
)
_BEFORE_CUE = re.compile(rf"(?<![\w.'’-])(?P<name>{_LATIN})$|(?P<han>[{_HAN}]{{2,}})$", re.I)
_WHOLE_NAME = re.compile(rf"(?:{_LATIN}|{_HAN_NAME})$", re.I)
_TITLE_WORD = re.compile(rf"{_TITLES}\.?$", re.I)
#: Words that no name begins with (fixed values).
_NO_NAME = frozenset(
    "the this that these those our your my his her its their a an and or but please which what when why how is are was were "
    "it we you they i he she everyone nobody somebody someone all any each no not ref see team support on for to in "
    "der die das ein eine und bitte wir sie le la les un une et nous vous el los las una y por de team ops oncall at of as by with lives from "
    "service gateway server cluster node job system database cache queue broker proxy api worker client monitor scheduler controller "
    "manager exporter pipeline stream region zone shard replica backup storage network router alert dashboard build release deploy".split()
)
_NO_HAN_NAME = re.compile(r"团队|运维|管理|部门|值班|同事|经理|客服|小组|支持|平台|系统|服务|工程|研发|负责|大家|我们|他们|专家|对应|相关|一下|业务|无法")


def _shape(word: str) -> str:
    return "upper" if word.isupper() and len(word) > 1 else "title" if word[:1].isupper() else "lower"


def _name_score(name: str) -> float:
    """What a name's own form adds: -1 if it can't be one."""
    if re.match(rf"[{_HAN}]", name):
        return -1.0 if _NO_HAN_NAME.search(name) else 0.1
    words = [w.strip(",.") for w in name.split()]
    main = [w for w in words if w.lower() not in _PARTICLES]
    if len(words) < 2 or not main or (len(words[0]) > 1 and words[0].lower() in _NO_NAME - set(_PARTICLES)) or main[-1].lower() in _NO_NAME:
        return -1.0
    shapes = {_shape(w) for w in main if len(w) > 1}
    return 0.3 if "lower" not in shapes else 0.05 if shapes == {"lower"} else -0.3


# --- scoring -----------------------------------------------------------------

#: Words that speak for or against a number of a kind (fixed values).
_SAYS_PHONE = re.compile(
    r"phone|mobile|(?<![a-z])tel\b|telef|teléf|handy|call|cell|fax|whatsapp|erreichbar|joignable|appel|llam|on call|电话|手机|联系|致电|打$|没人接|号码|热线", re.I
)
_SAYS_ID = re.compile(
    r"\bssn\b|social security|social insurance|insurance|identity|\bid number|\bid card|idcard|passport|passeport|pasaporte|reisepass|ausweis|\bnino\b|steuer|\bsécu|"
    r"\bnir\b|\bdni\b|\bnie\b|tax id|national|\biban\b|(?:credit|debit|bank) card|card (?:no|number)|身份证|证件|护照|身份|卡号|银行卡|账号", re.I
)
_SAYS_OTHER = re.compile(
    r"(?:(?<![a-z])(?:offset|seq|epoch|batch|build|sha|trace|span|ticket|job|shard|lane|partition|commit|uid|pid|port|attempt|generation|lag|ttl|size|limit|slot|"
    r"rows|keys|acks|version|order|invoice|request|req|code|line|thread)|偏移|批次|序号|端口|版本|工单|任务)(?: ?(?:id|no|nr|number)\.?)?[ :=#_-]{0,3}$",
    re.I,
)
_KIND_ORDER = {k: i for i, k in enumerate(KINDS)}


# --- gates -------------------------------------------------------------------

#: Bits of the patterns that a text's words make worth trying.
_BY_EMAIL, _BY_WORDS, _BY_HAN, _BY_LIST, _BY_BEHIND = (1 << i for i in range(5))
_BY_ADDRESS = 1 << 8
_BY_CUE = 1 << 16
ALL_GATES = (1 << 40) - 1

#: Letters that match plain ones where case doesn't count but don't turn into them, or into one letter, in lower case (fixed values).
_ODD_CASE = {0x130: "i", 0x131: "i", 0x17F: "s"}


def _starts_free(low: str, start: int, end: int) -> bool:
    return not start or not (low[start - 1].isalnum() or low[start - 1] in "_.-")


def _ends_free(low: str, start: int, end: int) -> bool:
    return end == len(low) or not (low[end].isalnum() or low[end] == "_")


def _digit_follows(low: str, start: int, end: int) -> bool:
    return end < len(low) and low[end].isdigit()


def _gate_words() -> ahocorasick.Automaton:
    """All words of which a match of some pattern has to hold one, so that a text is searched for them once.

    A word's entry is its length, the bits that it sets, and bits with what
    has to stand around the word for them.
    """
    numbers, digits = _NUMBER_WORD.split("|"), "零〇一二三四五六七八九幺"
    streets = [f" {w}" for w in _STREET.split("|")]
    ends = "straße strasse str. weg gasse allee platz ufer ring damm steig pfad".split()
    ways = "rue avenue av. impasse boulevard bd place chemin allée quai route cours passage square sentier".split()
    calles = "calle c/ avda avda. av. avenida plaza pza pza. paseo camino ronda travesía carrera glorieta".split()
    groups = [
        (_BY_EMAIL, ("@", "%40", "[at", "(at", "[ at", "( at", " dot "), None),
        (_BY_WORDS, [f"{a}{sign}{b}" for a in numbers for sign in " -" for b in numbers], None),
        (_BY_WORDS, [a + b for a in digits for b in digits], None),
        (_BY_HAN, ("号", "组", "弄"), None),
        (_BY_LIST, ("批人", "与人", "送人", "班人", "会人"), None),
        (_BY_BEHIND, (" signed off on", " approved the", " acknowledged the", " confirmed the", "freigabe", " a validé", " aprobó"), None),
        (_BY_BEHIND, ("老师", "先生", "女士", "同学", "经理", "工程师", "师傅", "主任"), None),
        (_BY_ADDRESS, ("box ", "postfach ", "apartado ", "bp "), _digit_follows),
        (_BY_ADDRESS << 1, streets, _ends_free),
        (_BY_ADDRESS << 2, [f"{w} " for w in ends], _digit_follows),
        (_BY_ADDRESS << 3, [f" {w} " for w in ways], None),
        (_BY_ADDRESS << 4, [f"{w} " for w in calles], None),
        *((_BY_CUE << i, words, _starts_free if words is _GATED_TITLES else None) for i, (words, *_) in enumerate(CUE_RULES)),
    ]
    gates: dict[str, tuple[int, int, list]] = {}
    for bit, words, condition in groups:
        for word in words:
            size, bits, conditional = gates.get(word, (len(word), 0, []))
            gates[word] = (size, bits, [*conditional, (bit, condition)]) if condition else (size, bits | bit, conditional)
    automaton = ahocorasick.Automaton()
    for word, entry in gates.items():
        automaton.add_word(word, entry)
    automaton.make_automaton()
    return automaton


def open_gates(plain: str) -> int:
    """The bits of all patterns that can match a text."""
    low = plain
    if not plain.isascii():
        low = plain.translate(_ODD_CASE) if any(c in plain for c in "İıſ") else plain
    low = low.lower()
    gates = 0
    for last, (size, bits, conditional) in GATES.iter(low):
        gates |= bits
        for bit, condition in conditional:
            if not gates & bit and condition(low, last + 1 - size, last + 1):
                gates |= bit
    return gates


def _context(text: str, start: int, end: int) -> tuple[str, str]:
    return text[max(0, start - 26) : start], text[end : end + 12]


#: Six digits that don't begin a time.
_SOME_DIGITS = re.compile(r"(?<![0-9])(?<![0-9]-)(?![0-9]{4}-[0-9]{2}-[0-9]{2}T)[0-9](?:[ ./()-]{0,2}[0-9]){5}")
_SOME_WORDS = re.compile(rf"(?:{_NUMBER_WORD})[ -](?:{_NUMBER_WORD})[ -]|[零〇一二三四五六七八九幺]{{7}}", re.I)


def _numbers(text: str, gates: int) -> Iterator[tuple[str, int, int, float]]:
    digits = gates == ALL_GATES or _SOME_DIGITS.search(text)
    if not digits and not (gates & _BY_WORDS and _SOME_WORDS.search(text)):
        return
    for m in PHONE.finditer(text):
        before, after = _context(text, *m.span())
        score = 0.35 if m.group()[0] in "+(" else 0.3
        n = len(_digits(m.group()))
        if n in (10, 11, 12, 13) or n == 0:
            score += 0.25
        if _SAYS_PHONE.search(before) or _SAYS_PHONE.search(after):
            score += 0.4
        if _SAYS_ID.search(before):
            score -= 0.5
        if _SAYS_OTHER.search(before):
            score -= 0.7
        yield "phone", *m.span(), score
    for pattern, base, check, bonus in IDS if digits else ():
        for m in pattern.finditer(text):
            score = base + (bonus if check and check(m.group()) else 0.0)
            before, after = _context(text, *m.span())
            if _SAYS_ID.search(before):
                score += 0.6
            if _SAYS_PHONE.search(before) and not _SAYS_ID.search(before):
                score -= 0.4
            if _SAYS_OTHER.search(before):
                score -= 0.7
            yield "id_number", *m.span(), score


def _addresses(text: str, gates: int) -> Iterator[tuple[str, int, int, float]]:
    for i, (pattern, base) in enumerate(ADDRESSES):
        for m in pattern.finditer(text) if gates & _BY_ADDRESS << i else ():
            before = text[max(0, m.start() - 30) : m.start()]
            score = base
            if re.search(r"lives at|mounted at|ship|deliver|address|located|geht an|wohnt|anschrift|trouve au|adresse|habite|está en|dirección|vive en|, $|: $", before, re.I):
                score += 0.3
            if any(c.isdigit() for c in m.group()):
                score += 0.1
            if m.group().islower():
                score -= 0.3
            yield "address", *m.span(), score
    if gates & _BY_HAN and (gates == ALL_GATES or _HAN_HOUSE.search(text)):
        for m in ADDRESS_HAN.finditer(text):
            yield "address", *m.span("span"), 0.9


def _names(text: str, gates: int) -> Iterator[tuple[str, int, int, float]]:
    for i, (pattern, base) in enumerate(CUES):
        if gates & _BY_CUE << i:
            at = 0
            while m := pattern.search(text, at):
                name, (start, end) = m.group("name"), m.span("name")
                score = base + _name_score(name)
                if 0 < _name_score(name) < 0.1 and re.match(r"[.。\n|]|$| [|¿¡A-ZÀ-Þ]", text[end : end + 2]):
                    score += 0.1
                yield "name", start, end, score
                at = start + 1
    for m in NAME_LIST.finditer(text) if gates & _BY_LIST else ():
        at = m.start("list")
        for item in re.split("([、&/]| and )", m.group("list")):
            if name := _WHOLE_NAME.match(item):
                yield "name", at, at + name.end(), 0.6 + _name_score(item)
            at += len(item)
    for m in BEHIND.finditer(text) if gates & _BY_BEHIND else ():
        base = max(0, m.start() - 60)
        if found := _BEFORE_CUE.search(text[base : m.start()]):
            start, name = base + found.start(), found.group()
            if found.group("han"):
                name = name[-4:] if len(name) <= 4 else name[-3:]
                start = m.start() - len(name)
            else:
                words = name.split(" ")
                last = _shape(words[-1])
                while len(words) > 2 and (
                    _TITLE_WORD.match(words[0])
                    or words[0].lower() not in _PARTICLES and len(words[0]) > 2 and _shape(words[0].strip(",")) != last
                ):
                    start += len(words[0]) + 1
                    words = words[1:]
                name = " ".join(words)
            yield "name", start, m.start(), 0.5 + _name_score(name)


GATES = _gate_words()


def _without_overlaps(found: Iterable[tuple[str, int, int, float]]) -> list[tuple[int, int, str, float]]:
    """The strongest of spans that overlap, in order; kept spans are found by binary search."""
    starts: list[int] = []
    kept: list[tuple[int, int, str, float]] = []
    for kind, start, end, score in sorted(found, key=lambda x: (_KIND_ORDER[x[0]] > 0, -x[3], x[1] - x[2], _KIND_ORDER[x[0]], x[1])):
        at = bisect_left(starts, start)
        if (at == 0 or kept[at - 1][1] <= start) and (at == len(starts) or starts[at] >= end):
            starts.insert(at, start)
            kept.insert(at, (start, end, kind, round(score, 3)))
    return kept


def find_spans(text: str | None, gated: bool = True) -> list[tuple[int, int, str, float]]:
    """The personal information in a text: (start, end, kind, score) in order, without overlaps.

    Without ``gated`` every pattern is tried, which finds the same.
    """
    if not text:
        return []
    plain = text.translate(_WIDE) if not text.isascii() else text
    gates = open_gates(plain) if gated else ALL_GATES
    found: list[tuple[str, int, int, float]] = []
    if gates & _BY_EMAIL:
        found += (("email", *m.span(), 0.95) for m in EMAIL.finditer(plain))
    found += _numbers(plain, gates)
    if gates:
        found += _addresses(plain, gates)
        found += _names(plain, gates)
    return _without_overlaps(x for x in found if x[3] >= THRESHOLD - 1e-9) if found else []


def mask_text(text: str | None) -> str | None:
    """The text with each span replaced by the placeholder of its kind."""
    out, at = [], 0
    for start, end, kind, _ in find_spans(text):
        out += [text[at:start], PLACEHOLDERS[kind]]
        at = end
    return text if not at else "".join([*out, text[at:]])


# --- DataFrames --------------------------------------------------------------


def found(rows: DataFrame, key: str, text: str) -> DataFrame:
    """``row_id, kind, start_pos, end_pos, score`` for each occurrence; ``end_pos`` is the last character's position."""
    source = rows.select(F.col(key).alias("row_id"), F.col(text).alias("text")).where(F.length("text") > 0)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            at, kinds, starts, ends, scores = [], [], [], [], []
            for i, content in enumerate(batch.column("text").to_pylist()):
                for start, end, kind, score in find_spans(content):
                    at.append(i)
                    kinds.append(kind)
                    starts.append(start + 1)
                    ends.append(end)
                    scores.append(score)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row_id").take(pa.array(at, pa.int64())),
                    pa.array(kinds, pa.string()),
                    pa.array(starts, pa.int64()),
                    pa.array(ends, pa.int64()),
                    pa.array(scores, pa.float64()),
                ],
                names=["row_id", "kind", "start_pos", "end_pos", "score"],
            )

    kind = source.schema["row_id"].dataType.simpleString()
    return spread(source).mapInArrow(scan, f"row_id {kind}, kind string, start_pos long, end_pos long, score double")


def masked(rows: DataFrame, text: str) -> DataFrame:
    """The rows with ``text`` masked; all other columns as they are."""
    names = rows.columns

    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            done = pa.array([mask_text(x) for x in batch.column(text).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([done if c == text else batch.column(c) for c in names], names=names)

    return spread(rows).mapInArrow(mask, rows.schema)
