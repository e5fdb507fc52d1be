"""Made-up values: small programs over a stream of draws.

A program is a list of parts. Each takes a fixed number of draws, so the same program runs in Python and compiles to a
column. Word lists are this package's own; values are plausible in shape and locale, nothing more.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Lit:
    text: str
    draws = 0

    def run(self, s, j: int) -> str:
        return self.text

    def column(self, s, j: int) -> Column:
        return F.lit(self.text)


@dataclass(frozen=True)
class Pick:
    """One of some words."""

    words: tuple[str, ...]
    draws = 1

    def run(self, s, j: int) -> str:
        return self.words[s.draw(j, len(self.words))]

    def column(self, s, j: int) -> Column:
        return F.element_at(F.array(*map(F.lit, self.words)), (s.draw(j, len(self.words)) + 1).cast("int"))


@dataclass(frozen=True)
class Number:
    """A whole number between two, padded with zeros to a width."""

    low: int
    high: int
    width: int = 0
    draws = 1

    def run(self, s, j: int) -> str:
        return str(self.low + s.draw(j, self.high - self.low + 1)).zfill(self.width)

    def column(self, s, j: int) -> Column:
        value = (s.draw(j, self.high - self.low + 1) + self.low).cast("string")
        return F.lpad(value, self.width, "0") if self.width else value


#: What a sign of a mask stands for; other signs stand for themselves.
SIGNS = {"#": "0123456789", "^": "123456789", "~": "0123456789abcdef", "?": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "@": "abcdefghijklmnopqrstuvwxyz", "*": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"}


@dataclass(frozen=True)
class Mask:
    """A text whose signs are drawn (see ``SIGNS``)."""

    mask: str
    signs: str = "".join(SIGNS)

    @property
    def draws(self) -> int:
        return sum(c in self.signs for c in self.mask)

    def run(self, s, j: int) -> str:
        out = []
        for c in self.mask:
            if c in self.signs:
                out.append(SIGNS[c][s.draw(j, len(SIGNS[c]))])
                j += 1
            else:
                out.append(c)
        return "".join(out)

    def column(self, s, j: int) -> Column:
        out = []
        for c in self.mask:
            if c in self.signs:
                out.append(F.substring(F.lit(SIGNS[c]), s.draw(j, len(SIGNS[c])).cast("int") + 1, 1))
                j += 1
            else:
                out.append(F.lit(c))
        return F.concat(*out) if out else F.lit("")


def _capital(text: Column) -> Column:
    from veilwork.functions.stream import let

    return let(text, lambda t: F.concat(F.upper(F.substring(t, 1, 1)), F.substring(t, 2, 1 << 20)))


@dataclass(frozen=True)
class Seq:
    """Parts one after another."""

    parts: tuple
    between: str = ""
    end: str = ""
    capital: bool = False

    @property
    def draws(self) -> int:
        return sum(p.draws for p in self.parts)

    def _at(self, j: int):
        for p in self.parts:
            yield p, j
            j += p.draws

    def run(self, s, j: int) -> str:
        text = self.between.join(p.run(s, k) for p, k in self._at(j)) + self.end
        return text[:1].upper() + text[1:] if self.capital else text

    def column(self, s, j: int) -> Column:
        text = F.concat(F.concat_ws(self.between, *(p.column(s, k) for p, k in self._at(j))), F.lit(self.end))
        return _capital(text) if self.capital else text


@dataclass(frozen=True)
class Some:
    """A part between ``low`` and ``high`` times; draws for all of them are set apart."""

    part: Any
    low: int
    high: int
    between: str
    before: str = ""
    end: str = ""
    capital: bool = False

    @property
    def draws(self) -> int:
        return 1 + self.high * self.part.draws

    def _shown(self, text):
        return text

    def run(self, s, j: int) -> str:
        n = self.low + s.draw(j, self.high - self.low + 1)
        text = self.between.join(self.before + self.part.run(s, j + 1 + i * self.part.draws) for i in range(n)) + self.end
        return text[:1].upper() + text[1:] if self.capital else text

    def column(self, s, j: int) -> Column:
        every = F.array(*(F.concat(F.lit(self.before), self.part.column(s, j + 1 + i * self.part.draws)) for i in range(self.high)))
        text = F.concat(F.array_join(F.slice(every, 1, (s.draw(j, self.high - self.low + 1) + self.low).cast("int")), self.between), F.lit(self.end))
        return _capital(text) if self.capital else text


def seq(*parts: Any, between: str = "", **more: Any) -> Seq:
    return Seq(tuple(Lit(p) if isinstance(p, str) else p for p in parts), between, **more)


def pick(words: str) -> Pick:
    return Pick(tuple(w.strip() for w in words.split(",")))


# -- words by locale ------------------------------------------------------------------------------------------------------

FIRST = {
    "en": "Alice, Brian, Chloe, Daniel, Ella, Frank, Grace, Henry, Isla, Jack, Kate, Liam, Mia, Noah, Olivia, Peter",
    "fr_fr": "Amélie, Benoît, Camille, Denis, Élise, François, Gaëlle, Hugo, Inès, Julien, Léa, Mathieu",
    "de_de": "Anke, Bernd, Clara, Dieter, Elke, Felix, Greta, Hans, Ilse, Jürgen, Katrin, Lukas",
    "it_it": "Alessia, Bruno, Chiara, Davide, Elena, Fabio, Giulia, Lorenzo, Marta, Nicola, Paola, Sergio",
    "pt_br": "Ana, Bruno, Carla, Diego, Eduarda, Felipe, Gabriela, Heitor, Júlia, Lucas, Mariana, Rafael",
    "pt_pt": "Afonso, Beatriz, Catarina, Duarte, Filipa, Gonçalo, Inês, João, Leonor, Miguel, Rita, Tiago",
    "ar_sa": "أحمد, سارة, خالد, ليلى, محمد, نورة, سعد, فاطمة, عمر, هند",
    "zh_cn": "伟, 芳, 娜, 敏, 静, 强, 磊, 洋, 艳, 杰",
    "zh_tw": "志明, 淑芬, 家豪, 美玲, 俊傑, 雅婷, 建宏, 怡君, 宗翰, 佳穎",
    "ja_jp": "太郎, 花子, 健, 美咲, 翔, 葵, 大輔, 結衣, 直樹, 陽菜",
    "cy_gb": "Aled, Bethan, Carys, Dafydd, Eleri, Gareth, Heledd, Ieuan, Llinos, Megan, Rhys, Siân",
}
LAST = {
    "en": "Adams, Baker, Carter, Dixon, Evans, Foster, Green, Hughes, Irwin, Jones, King, Lewis, Mason, Nolan, Owen, Price",
    "fr_fr": "Aubert, Blanc, Caron, Dubois, Fabre, Garnier, Lambert, Mercier, Noël, Petit, Rousseau, Vidal",
    "de_de": "Albrecht, Becker, Dietrich, Fischer, Graf, Hofmann, Krüger, Lehmann, Müller, Neumann, Schäfer, Vogel",
    "it_it": "Bianchi, Colombo, De Luca, Esposito, Ferrari, Gallo, Marino, Ricci, Romano, Serra, Villa, Conti",
    "pt_br": "Almeida, Barbosa, Cardoso, Dias, Ferreira, Gomes, Lima, Moreira, Oliveira, Pereira, Souza, Teixeira",
    "pt_pt": "Antunes, Barros, Carvalho, Esteves, Faria, Guerreiro, Lopes, Matos, Neves, Pinto, Sequeira, Tavares",
    "ar_sa": "العتيبي, الحربي, القحطاني, الشمري, الغامدي, الزهراني, الدوسري, المطيري",
    "zh_cn": "王, 李, 张, 刘, 陈, 杨, 赵, 黄, 周, 吴",
    "zh_tw": "陳, 林, 黃, 張, 李, 王, 吳, 劉, 蔡, 楊",
    "ja_jp": "佐藤, 鈴木, 高橋, 田中, 伊藤, 渡辺, 山本, 中村, 小林, 加藤",
    "cy_gb": "Bowen, Davies, Ellis, Griffiths, Howells, Jenkins, Llewellyn, Morgan, Parry, Powell, Rees, Vaughan",
}
PHONE = {
    "en": "(^##) ^##-####", "fr_fr": "+33 ^ ## ## ## ##", "de_de": "+49 ^### #######", "it_it": "+39 3## #######", "pt_br": "(^#) 9####-####", "pt_pt": "+351 2## ### ###",
    "ar_sa": "+966 5# ### ####", "zh_cn": "1^# #### ####", "zh_tw": "09## ### ###", "ja_jp": "0^-####-####", "cy_gb": "01^## ######",
}
CELL = PHONE | {"en": "^##-^##-####", "fr_fr": "06 ## ## ## ##", "de_de": "+49 15^ #######", "pt_pt": "+351 9## ### ###", "ja_jp": "090-####-####", "cy_gb": "07^## ######"}
CITY = {
    "en": "Ashford, Brookfield, Clayton, Dunmore, Eastwick, Fairview, Glenhaven, Harrow, Kingsley, Lakewood", "fr_fr": "Beaulieu, Clairmont, Fontenay, Villeneuve, Montclair", "de_de": "Altdorf, Neustadt, Rosenheim, Steinbach, Waldau",
    "it_it": "Borgonovo, Castelvecchio, Montefiore, Roccabianca", "pt_br": "Boa Vista, Campo Belo, Porto Claro, Serra Azul", "pt_pt": "Aldeia Nova, Monte Real, Vila Formosa", "ar_sa": "الرياض, جدة, الدمام, أبها", "zh_cn": "安平, 宁海, 长乐, 永定",
    "zh_tw": "新城, 永和, 安樂, 大同", "ja_jp": "青葉, 桜川, 緑区, 若松", "cy_gb": "Aberwen, Llanfair, Pentre, Trefor",
}

_DOMAIN = pick("example.com, example.org, example.net")
_USER = seq(pick("amber, birch, cedar, delta, ember, falcon, grove, harbor, indigo, juniper, kite, lark, maple, nova, onyx, pine"), pick("_, ., -"), pick("fox, hill, lane, moon, oak, park, reed, sky, stone, tide, vale, wood"), Number(1, 9999))
_WORD = pick("arbor, bellum, campus, domus, ensis, fluvius, gratia, herba, ignis, locus, mensa, nox, opus, porta, quies, rosa, silva, terra, umbra, ventus, vita, aqua, lumen, mons, navis, pax, ratio, sol, tempus, via")
_COUNTRY = "Argentina, Austria, Brazil, Canada, Chile, Denmark, Egypt, Finland, Ghana, India, Japan, Kenya, Mexico, Norway, Peru, Spain, Sweden, Vietnam"
_EXTENSION = pick("csv, txt, pdf, png, jpg, json, xml, zip, docx, html")
_FILE = seq(_WORD, "_", _WORD, ".", _EXTENSION)
_DIR = Some(_WORD, 2, 4, "/", end="")
_BUZZ = pick("adaptive, balanced, cross-platform, digital, extended, focused, global, horizontal, integrated, managed, networked, open, reduced, secured, universal")
_BUZZ_MIDDLE = pick("24-hour, analyzing, asynchronous, bottom-line, client-driven, coherent, dynamic, even-keeled, fault-tolerant, local, modular, needs-based, optimal, real-time, scalable")
_BUZZ_TAIL = pick("access, algorithm, approach, archive, budget, capability, forecast, framework, hub, interface, matrix, model, portal, protocol, toolset")
_VERB, _ADJ, _NOUN = pick("align, build, deliver, deploy, enable, extend, grow, harness, mesh, scale, shape, unlock"), pick("agile, clear, efficient, frictionless, global, lean, modern, rich, robust, seamless, smart, vertical"), pick("channels, content, experiences, markets, metrics, networks, platforms, portals, services, solutions, systems, users")
_FIELD, _SENIORITY = pick("Accounting, Banking, Community, Construction, Design, Education, Farming, Government, Healthcare, Legal, Marketing, Mining, Sales, Technology"), pick("Junior, Senior, Lead, Chief, Principal, Regional, District, Internal, Global, Associate")
_POSITION = pick("Administrator, Agent, Analyst, Architect, Assistant, Consultant, Coordinator, Designer, Developer, Director, Engineer, Manager, Officer, Planner, Specialist")
_SENTENCE_WORDS = (4, 10)


def _luhn_seq(mask: str) -> "Checked":
    return Checked(Mask(mask), "luhn")


@dataclass(frozen=True)
class Checked:
    """Digits followed by their check digit: Luhn's, an ISBN-10's or an ISBN-13's."""

    part: Mask
    kind: str

    @property
    def draws(self) -> int:
        return self.part.draws

    def run(self, s, j: int) -> str:
        text = self.part.run(s, j)
        digits = [int(c) for c in text if c.isdigit()]
        return text + check_digit(digits, self.kind)

    def column(self, s, j: int) -> Column:
        from veilwork.functions.stream import let

        plain = all(c.isdigit() or c in "#^" and c in self.part.signs for c in self.part.mask)
        digits = (lambda text: text) if plain else (lambda text: F.regexp_replace(text, "[^0-9]", ""))
        return let(self.part.column(s, j), lambda text: F.concat(text, let(digits(text), lambda d: check_digit_column(d, self.kind, self.part))))


def check_digit(digits: list[int], kind: str) -> str:
    if kind == "luhn":
        total = sum(d if i % 2 else (2 * d if d < 5 else 2 * d - 9) for i, d in enumerate(reversed(digits)))
        return str(-total % 10)
    if kind == "isbn13":
        return str(-sum(d * (3 if i % 2 else 1) for i, d in enumerate(digits)) % 10)
    rest = -sum(d * (10 - i) for i, d in enumerate(digits)) % 11
    return "X" if rest == 10 else str(rest)


def check_digit_column(digits: Column, kind: str, part: Mask) -> Column:
    from veilwork.functions.stream import let

    n = sum(c in part.signs or c.isdigit() for c in part.mask)
    if kind == "luhn":
        odd, even = ([i for i in range(n) if (n - i) % 2 == rest] for rest in (1, 0))
        total = lambda text, places: sum((F.substring(text, i + 1, 1).cast("int") for i in places), F.lit(0))
        return let(F.translate(digits, "0123456789", "0246813579"), lambda doubled: F.pmod(-(total(doubled, odd) + total(digits, even)), F.lit(10)).cast("string"))
    each = [F.substring(digits, i + 1, 1).cast("int") for i in range(n)]
    if kind == "isbn13":
        return F.pmod(-sum((d * (3 if i % 2 else 1) for i, d in enumerate(each)), F.lit(0)), F.lit(10)).cast("string")
    rest = F.pmod(-sum((d * (10 - i) for i, d in enumerate(each)), F.lit(0)), F.lit(11))
    return F.when(rest == 10, "X").otherwise(rest.cast("string"))


def _locale(spec: Any) -> str:
    return (spec.locale or "en").lower()


def first_name(locale: str) -> Any:
    return pick(FIRST[locale])


def last_name(locale: str) -> Any:
    return pick(LAST[locale])


def full_name(locale: str) -> Any:
    family_first = locale in ("zh_cn", "zh_tw", "ja_jp")
    return seq(last_name(locale), first_name(locale), between=" " if locale == "ja_jp" else "") if family_first else seq(first_name(locale), last_name(locale), between=" ")


def safe_email(locale: str) -> Any:
    return seq(_USER, "@", _DOMAIN)


def phone(locale: str) -> Any:
    return Mask(PHONE[locale], "#^")


def _counts(spec: Any, low: int, high: int) -> tuple[int, int]:
    low, high = (low if spec.min is None else spec.min), (high if spec.max is None else spec.max)
    low = max(0, min(low, 100))
    return low, max(low, min(high, 100))


def _sentence(low: int = _SENTENCE_WORDS[0], high: int = _SENTENCE_WORDS[1]) -> Some:
    return Some(_WORD, low, high, " ", end=".", capital=True)


def _paragraph(low: int = 4, high: int = 7) -> Some:
    return Some(_sentence(4, 7), low, high, " ")


#: Generator by lower-cased ``module::type``: from a spec to a program.
GENERATORS = {
    "name::firstname": lambda s: first_name(_locale(s)),
    "name::lastname": lambda s: last_name(_locale(s)),
    "name::name": lambda s: full_name(_locale(s)),
    "name::namewithtitle": lambda s: seq(pick("Mr., Mrs., Ms., Dr., Prof."), full_name(_locale(s)), between=" "),
    "name::title": lambda s: pick("Mr., Mrs., Ms., Dr., Prof."),
    "name::suffix": lambda s: pick("Jr., Sr., I, II, III, IV, MD, PhD"),
    "internet::freeemail": lambda s: seq(_USER, "@", pick("freemail.example, webmail.example, postbox.example")),
    "internet::safeemail": lambda s: safe_email(_locale(s)),
    "internet::username": lambda s: _USER,
    "internet::freeemailprovider": lambda s: pick("freemail.example, webmail.example, postbox.example"),
    "internet::domainsuffix": lambda s: pick("com, net, org, info, biz, io"),
    "internet::ipv4": lambda s: seq(Number(1, 254), Number(0, 255), Number(0, 255), Number(1, 254), between="."),
    "internet::ipv6": lambda s: Mask("2001:db8:~~~~:~~~~:~~~~:~~~~:~~~~:~~~~", "~"),
    "internet::ip": lambda s: seq(Number(1, 254), Number(0, 255), Number(0, 255), Number(1, 254), between="."),
    "internet::macaddress": lambda s: Mask("02:~~:~~:~~:~~:~~", "~"),
    "internet::useragent": lambda s: seq("Mozilla/5.0 (", pick("X11; Linux x86_64, Windows NT 10.0; Win64; x64, Macintosh; Intel Mac OS X 10_15"), ") Gecko/20100101 Firefox/", Number(90, 140), ".0"),
    "internet::password": lambda s: Mask("*" * (s.length or 12), "*"),
    "phone_number::phonenumber": lambda s: phone(_locale(s)),
    "phone_number::cellnumber": lambda s: Mask(CELL[_locale(s)], "#^"),
    "address::cityprefix": lambda s: pick("North, South, East, West, New, Lake, Port"),
    "address::citysuffix": lambda s: pick("town, ton, land, ville, berg, burgh, borough, bury, view, port"),
    "address::cityname": lambda s: pick(CITY[_locale(s)]),
    "address::countryname": lambda s: pick(_COUNTRY),
    "address::countrycode": lambda s: pick("AR, AT, BR, CA, CL, DK, EG, FI, GH, IN, JP, KE, MX, NO, PE, ES, SE, VN"),
    "address::streetsuffix": lambda s: pick("Avenue, Court, Drive, Lane, Place, Road, Street, Way"),
    "address::streetname": lambda s: seq(last_name(_locale(s)), pick("Avenue, Court, Drive, Lane, Place, Road, Street, Way"), between=" "),
    "address::timezone": lambda s: pick("Europe/London, Europe/Paris, America/New_York, America/Lima, Asia/Tokyo, Asia/Kolkata, Africa/Cairo, Australia/Sydney"),
    "address::statename": lambda s: pick("Alabama, Colorado, Georgia, Idaho, Kansas, Maine, Nevada, Ohio, Oregon, Texas, Utah, Vermont"),
    "address::stateabbr": lambda s: pick("AL, CO, GA, ID, KS, ME, NV, OH, OR, TX, UT, VT"),
    "address::secondaryaddresstype": lambda s: pick("Apt., Suite, Unit"),
    "address::secondaryaddress": lambda s: seq(pick("Apt., Suite, Unit"), Number(1, 999), between=" "),
    "address::zipcode": lambda s: Mask("^####", "#^"),
    "address::postcode": lambda s: Mask("^####", "#^"),
    "address::buildingnumber": lambda s: Number(1, 9999),
    "address::latitude": lambda s: seq(Number(-89, 89), ".", Mask("######", "#")),
    "address::longitude": lambda s: seq(Number(-179, 179), ".", Mask("######", "#")),
    "address::geohash": lambda s: Some(pick("0, 1, 2, 3, 4, 5, 6, 7, 8, 9, b, c, d, e, f, g, h, j, k, m, n, p, q, r, s, t, u, v, w, x, y, z"), *(max(1, min(20, 8 if s.min is None else s.min)),) * 2, ""),
    "company::companysuffix": lambda s: pick("Inc., LLC, Ltd., Group, and Sons"),
    "company::companyname": lambda s: seq(last_name(_locale(s)), pick("Inc., LLC, Ltd., Group, and Sons"), between=" "),
    "company::buzzword": lambda s: _BUZZ,
    "company::buzzwordmiddle": lambda s: _BUZZ_MIDDLE,
    "company::buzzwordtail": lambda s: _BUZZ_TAIL,
    "company::catchphrase": lambda s: seq(_BUZZ, _BUZZ_MIDDLE, _BUZZ_TAIL, between=" ", capital=True),
    "company::bsverb": lambda s: _VERB,
    "company::bsadj": lambda s: _ADJ,
    "company::bsnoun": lambda s: _NOUN,
    "company::bs": lambda s: seq(_VERB, _ADJ, _NOUN, between=" "),
    "company::profession": lambda s: pick("baker, carpenter, chemist, dentist, editor, farmer, geologist, nurse, painter, pilot, plumber, teacher, translator, welder"),
    "company::industry": lambda s: pick("agriculture, automotive, banking, education, energy, healthcare, insurance, logistics, media, retail, software, tourism"),
    "job::seniority": lambda s: _SENIORITY,
    "job::field": lambda s: _FIELD,
    "job::position": lambda s: _POSITION,
    "job::title": lambda s: seq(_SENIORITY, _FIELD, _POSITION, between=" "),
    "lorem::word": lambda s: _WORD,
    "lorem::words": lambda s: Some(_WORD, *_counts(s, 3, 5), " "),
    "lorem::sentence": lambda s: _sentence(*_counts(s, *_SENTENCE_WORDS)),
    "lorem::sentences": lambda s: Some(_sentence(), *_counts(s, 2, 4), " "),
    "lorem::paragraph": lambda s: _paragraph(*_counts(s, 4, 7)),
    "lorem::paragraphs": lambda s: Some(_paragraph(3, 4), *_counts(s, 2, 4), "\n"),
    "markdown::italicword": lambda s: seq("*", _WORD, "*"),
    "markdown::boldword": lambda s: seq("**", _WORD, "**"),
    "markdown::link": lambda s: seq("[", _WORD, "](https://", _DOMAIN, "/", _WORD, ")"),
    "markdown::bulletpoints": lambda s: Some(_sentence(3, 6), *_counts(s, 2, 5), "\n", before="- "),
    "markdown::listitems": lambda s: Some(_sentence(3, 6), *_counts(s, 2, 5), "\n", before="1. "),
    "markdown::blockquotesingleline": lambda s: Some(_sentence(3, 6), *_counts(s, 1, 3), " ", before=""),
    "markdown::blockquotemultiline": lambda s: Some(_sentence(3, 6), *_counts(s, 2, 4), "\n", before="> "),
    "markdown::code": lambda s: seq("`", Some(_WORD, *_counts(s, 3, 8), " "), "`"),
    "number::digit": lambda s: Mask("#", "#"),
    "number::numberwithformat": lambda s: Mask(s.format, "#^"),
    "boolean::boolean": lambda s: Pick(("true",) * _ratio(s) + ("false",) * (100 - _ratio(s))),
    "barcode::isbn": lambda s: Checked(Mask("978^########", "#^"), "isbn13"),
    "barcode::isbn10": lambda s: Checked(Mask("^########", "#^"), "isbn10"),
    "barcode::isbn13": lambda s: Checked(Mask("978^########", "#^"), "isbn13"),
    "creditcard::creditcardnumber": lambda s: Checked(Mask("4##############", "#"), "luhn"),
    "currency::currencycode": lambda s: pick("AUD, BRL, CAD, CHF, CNY, DKK, EUR, GBP, INR, JPY, MXN, NOK, SEK, USD"),
    "currency::currencyname": lambda s: pick("Australian Dollar, Real, Canadian Dollar, Swiss Franc, Yuan, Danish Krone, Euro, Pound Sterling, Rupee, Yen, Peso, Krona, US Dollar"),
    "currency::currencysymbol": lambda s: pick("$, R$, €, £, ¥, ₹, kr"),
    "finance::bic": lambda s: Mask("????GB2L", "?"),
    "finance::isin": lambda s: Mask("US##########", "#"),
    "filesystem::filepath": lambda s: seq("/", _DIR, "/", _FILE),
    "filesystem::filename": lambda s: _FILE,
    "filesystem::fileextension": lambda s: _EXTENSION,
    "filesystem::dirpath": lambda s: seq("/", _DIR),
    "filesystem::mimetype": lambda s: pick("text/plain, text/csv, text/html, application/json, application/pdf, application/zip, image/png, image/jpeg"),
    "filesystem::semver": lambda s: seq(Number(0, 9), Number(0, 20), Number(0, 20), between="."),
    "filesystem::semverstable": lambda s: seq(Number(1, 9), Number(0, 20), Number(0, 20), between="."),
    "filesystem::semverunstable": lambda s: seq(Number(0, 9), ".", Number(0, 20), ".", Number(0, 20), "-", pick("alpha, beta, rc"), ".", Number(1, 9)),
}
ALIASES = {"phone_number::phone": "phone_number::phonenumber", "phone_number::cell": "phone_number::cellnumber"}


def _ratio(s: Any) -> int:
    return max(0, min(100, 50 if s.min is None else s.min))


def parse_path(path: str) -> str | None:
    """``module::Type`` in lower case, or None."""
    module, mark, kind = path.strip().partition("::")
    return f"{module.strip()}::{kind.strip()}".lower() if mark and module.strip() and kind.strip() and "::" not in kind else None


def is_supported(spec: Any) -> bool:
    key = parse_path(spec.faker or "")
    key = ALIASES.get(key, key)
    return key in GENERATORS and (key != "number::numberwithformat" or bool(spec.format))


def program(spec: Any) -> Any:
    """The program of a ``faker``, ``email``, ``name``, ``first_name``, ``last_name`` or ``phone`` strategy."""
    own = {"email": safe_email, "name": full_name, "first_name": first_name, "last_name": last_name, "phone": phone}.get(spec.strategy)
    if own is not None:
        return own(_locale(spec))
    key = parse_path(spec.faker)
    return GENERATORS[ALIASES.get(key, key)](spec)
