"""Sentences for measuring problem 9: written for this test, in English, German and Chinese, with pieces of
every type made by rule. None uses a sentence, a name or a number of the test tables."""

from __future__ import annotations

import random

GIVEN = (
    "Alice Henry Margaret Oliver Fatima Kenji Lukas Sabine Matthias Katharina Thandiwe Kwabena Ngozi Saoirse Piotr Agnieszka Giulia Matteo Bjarne Astrid "
    "Rajesh Sunita Minh Hyun Tariq Leila Xavier Beatriz Anneliese Gottfried Rosalind Desmond"
).split()
FAMILY = (
    "Johnson Whitaker Okafor Tanaka Brandt Schreiber Kowalczyk O'Brien McCarthy Rossi Lindqvist Banerjee Nguyen Haddad Moreau Ferreira Vogelsang Castellano "
    "Abernathy Mokoena Pemberton Zimmermann Delgado Ashworth Krüger Böhm Vasquez Thornbury"
).split()
FAMILY_ZH, GIVEN_ZH = "陈林郑谢唐许邓冯曹彭蒋韩", "伟 建国 丽华 敏 晓东 志强 雪梅 子涵 文博 秀英 俊杰 欣怡".split()
NAME_EN = (
    "Please contact {} tomorrow.", "This section was reviewed by {}.", "My name is {} and I maintain the parser.", "{} said the lock order is wrong.", "We met {} at the planning session.",
    "Hi {}, could you look at this?", "Approved by {} on Friday.", "The analysis by {} covers both branches.", "{} reported the crash last week.", "Assignee: {}", "Mr. {} will join the call.",
    "I talked to {} about the deadline.", "Forwarded to {} for triage.", "According to {}, the buffer is large enough.", "{} wrote the original loader.", "Tested-by: {}", "Kind regards\n-- {}",
    "Ms. {} explained the patch.", "Yesterday {} agreed to the plan.", "Ticket owner: {}",
)
NAME_DE = (
    "Bitte kontaktieren Sie {} bis morgen.", "Der Bericht wurde verfasst von {}.", "Herr {} übernimmt den Fall.", "{} meldete den Absturz.", "Laut {} ist der Puffer groß genug.", "Hallo {}, bitte prüfen.",
    "Ansprechpartnerin: {}", "Freigegeben von {} am Freitag.", "Mein Name ist {}.", "{} sagte, die Prüfung fehle.", "Weitergeleitet an {}.", "Wir danken Frau {} für den Hinweis.",
)
NAME_ZH = ("请联系{}。", "报告由{}提交。", "姓名：{}", "{}说缓冲区足够大。", "我们已通知{}。", "工程师：{}", "{}认为这不是漏洞。", "该补丁由{}审核。")
PLACES = (
    ("{} is my work address.", "Mail {} when done.", "Reply to <{}>.", "bug reports: {}", "ask {} for access"), ("Schreiben Sie an {}.", "Erreichbar unter {}", "E-Mail: {}"), ("邮箱 {}", "请发送到{}。", "发件人：{}"),
)
PHONE = (("Call me on {}.", "Phone: {}", "My cell is {}", "reach the desk at {} after nine"), ("Telefon: {}", "Sie erreichen mich unter {}.", "Rufnummer {}"), ("手机：{}", "电话 {}。", "请致电{}"))
IDENTITY = (
    (("My SSN is {}.", "social security number: {}", "taxpayer {} filed late"), "ssn"), (("National Insurance number {}", "NI number: {}", "his NINO is {}."), "nino"), (("passport {}", "Passport number: {}", "holder of travel document {}"), "passport"),
    (("Steuer-ID: {}", "Die Steuernummer lautet {}.", "IdNr {}"), "tax"), (("身份证号码{}", "证件：{}", "身份证：{}。"), "resident"),
)
STREETS = "Maple Birch Harbor Kensington Lincoln Willow Juniper Franklin Cedar Thornhill".split()
ADDRESS = (
    (("I live at {}.", "Send it to {}, Springfield.", "Our office is at {}.", "Delivery address: {}"), "en"), (("Wir wohnen in der {}.", "Büro: {}", "Bitte liefern an {}.", "Adresse: {}, 10115 Berlin"), "de"), (("地址：{}", "我住在{}。", "公司位于{}，五楼"), "zh"),
)
NOTHING = (
    "The Ring Buffer is full and the Session Manager never moves.", "Build 078-05-1120 fails on Port Eighty.", "See RFC 2119 and ISO 27001 for details.", "Heap Walker says nothing; Token Index is empty.", "12 345 678 901 items were read in 20 Passes.",
    "version 10.0.19041.1 at 0x7fffdeadbeef", "card 110105194912310021 was refused", "timestamps 1712882355 and 1712882355123", "Am Montag 12 Uhr tagt das Team Sicherheit.", "Im Jahr 2024 wurden 415 Fälle gemeldet.",
    "range 347-945-347945 and 2024-0234-0769", "The Linux Kernel was patched by Continuous Integration.", "memcpy@plt calls handle@@VERS_2.41", "第 12 号任务经过道路检查", "Route 66 Lane 3 is a test vector", "Der Wert Länge wird von Eingabe Prüfung gesetzt.",
)


def _resident(r: random.Random) -> str:
    body = f"{r.choice(('110105', '310104', '440305', '510107'))}{r.randint(1950, 2005)}{r.randint(1, 12):02}{r.randint(1, 28):02}{r.randint(1, 999):03}"
    return body + "10X98765432"[sum(int(c) * pow(2, 17 - k, 11) for k, c in enumerate(body)) % 11]


def _identity(r: random.Random, kind: str) -> str:
    if kind == "ssn":
        return f"{r.randint(100, 665)}-{r.randint(1, 99):02}-{r.randint(1, 9999):04}"
    if kind == "nino":
        gap = r.choice(("", " "))
        return r.choice(("AB", "CE", "JK", "SR", "WX")) + gap + gap.join(f"{r.randint(0, 99):02}" for _ in range(3)) + gap + r.choice("ABCD")
    if kind == "passport":
        return r.choice((f"E{r.randint(10**7, 10**8 - 1)}", f"C{r.randint(10, 99)}X{r.randint(10, 99)}T{r.randint(10, 99)}", f"{r.randint(10**8, 10**9 - 1)}"))
    if kind == "tax":
        d = f"{r.randint(10**10, 10**11 - 1)}"
        return r.choice((d, f"{d[:2]} {d[2:5]} {d[5:8]} {d[8:]}"))
    return _resident(r)


def _phone(r: random.Random) -> str:
    n = lambda k: str(r.randint(10 ** (k - 1), 10**k - 1))
    us = f"{r.randint(2, 9)}{r.randint(0, 9)}{r.randint(0, 9)}"
    return r.choice((
        f"+1 {us} 555 {n(4)}", f"({us}) 555-{n(4)}", f"{us}-555-{n(4)}", f"+44 161 496 0{n(3)}", f"0161 496 0{n(3)}", f"+49 89 {n(7)}", f"089/{n(7)}", f"0171 {n(7)}", f"+49 (0)711 {n(6)}", f"1{r.choice('35789')}{n(1)}{n(8)}",
        f"1{r.choice('35789')}{n(1)}-{n(4)}-{n(4)}", f"+86 138 {n(4)} {n(4)}", f"021-{n(8)}", f"+33 1 {n(2)} {n(2)} {n(2)} {n(2)}",
    ))


def _email(r: random.Random) -> str:
    who = f"{r.choice(GIVEN)}{r.choice('._-+')}{r.choice(FAMILY).replace(chr(39), '')}{r.choice(('', str(r.randint(1, 99))))}"
    who = who.translate(str.maketrans("üöä", "uoa"))
    site = r.choice(("acme-widgets.com", "mail.university.edu", "firma.de", "shop.co.uk", "service.cn", "research.org"))
    style = r.random()
    if style < 0.75:
        return f"{r.choice((who, who.lower()))}@{site}"
    if style < 0.9:
        return f"{who.lower()}{r.choice((' (at) ', '[at]', ' [at] '))}{site}"
    return f"{who.lower()} at {site.replace('.', ' dot ')}"


def _address(r: random.Random, kind: str) -> str:
    if kind == "en":
        return f"{r.randint(1, 9999)}{r.choice(('', '', 'B'))} {r.choice(('', '', 'N. ', 'West '))}{r.choice(STREETS)} {r.choice(('Street', 'Avenue', 'Road', 'Lane', 'Drive', 'Court', 'St', 'Blvd'))}"
    if kind == "de":
        return r.choice(("Hauptstraße", "Goethestr.", "Lindenallee", "Bergmannweg", "Am Stadtpark", "Karl-Marx-Allee", "Berliner Straße", "Marktplatz", "Unter den Linden")) + f" {r.randint(1, 199)}{r.choice(('', '', 'a'))}"
    return f"{r.choice(('人民', '中山北', '解放', '建设', '和平'))}{r.choice(('路', '街', '大道'))}{r.randint(1, 999)}号"


def _name(r: random.Random) -> str:
    g, f = r.choice(GIVEN), r.choice(FAMILY)
    return r.choice((f"{g} {f}", f"{g} {f}", f"{g} {f}", f"{g} {r.choice('ABCDHJ')}. {f}", f"{g[0]}. {f}", f"{g.upper()} {f.upper()}"))


def sentences(seed: int = 1, each: int = 400) -> list[tuple[str, list[tuple[str, str]]]]:
    """(text, [(type, piece)]): ``each`` sentences of every type, and as many without any piece."""
    r, out = random.Random(seed), []
    for _ in range(each):
        name = _name(r)
        out.append((r.choice(NAME_EN + NAME_DE).format(name), [("name", name)]))
        zh = r.choice(FAMILY_ZH) + r.choice(GIVEN_ZH)
        out.append((r.choice(NAME_ZH).format(zh), [("name", zh)]))
        for kind, forms, made in (("email", PLACES, _email(r)), ("phone", PHONE, _phone(r))):
            out.append((r.choice(r.choice(forms)).format(made), [(kind, made)]))
        forms, what = r.choice(IDENTITY)
        made = _identity(r, what)
        out.append((r.choice(forms).format(made), [("identity", made)]))
        forms, what = r.choice(ADDRESS)
        made = _address(r, what)
        out.append((r.choice(forms).format(made), [("address", made)]))
        out.append((r.choice(NOTHING), []))
    return out


def measure(pieces, seed: int = 1, each: int = 400) -> dict[str, tuple[int, int, int]]:
    """Per type: planted, found, both."""
    out = {k: [0, 0, 0] for k in ("email", "phone", "identity", "address", "name")}
    for text, want in sentences(seed, each):
        got = [(k, text[a:b]) for a, b, k in pieces(text)]
        for k, _ in want:
            out[k][0] += 1
        for k, p in got:
            out[k][1] += 1
            out[k][2] += (k, p) in want
    return {k: tuple(v) for k, v in out.items()}
