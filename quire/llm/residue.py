"""Problem 1: template residue, filler, error messages and script notices.

Character n-gram models of residue (unfilled templates, filler, error and script
notices) and of natural prose (from all texts of the tables themselves) give
every position of a text a log-likelihood ratio.  Windows of the ratio localise
residue, and a unit (a sentence or what stands between blank lines) is residue when
such windows cover most of it.  A sentence that speaks about or quotes residue is
covered in part only; code between fences is left out.

The residue models are fitted on a grammar in words of our own, on the status and
error texts of the Python library, on the usual Latin filler, and on classes of
characters: an unfilled field of any name and a word that is repeated again and
again are each written as one character.  They then learn from the texts: whole
blocks that score as residue join the residue side (and leave the prose side), and
the fit is repeated, so that wordings the grammar lacks come in by their neighbours.
Counts of n-grams add up over texts, so the fit covers every row and does not
depend on their order or partitions.

Defined results: null and empty texts are no residue; units of fewer than
MIN_UNIT characters that are not the whole text are ignored; repeated rows give
repeated results.  The fit and the search cover all rows and whole texts.
"""

from __future__ import annotations

import errno
import math
import os
import random
import re
from collections.abc import Callable, Iterable, Iterator
from http import HTTPStatus
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.runtime import broadcast_if_small, cut_lineage

#: Lengths of the n-grams; their ratios are averaged.
ORDERS = (3, 5)
N = max(ORDERS)
BITS = 20
WINDOW = 15
#: Mean log-likelihood ratio from which a window counts as residue.
WINDOW_RATIO = 0.35
COVERAGE = 0.55
#: Sum of the ratios that a unit needs: evidence, not only a share.
MIN_EVIDENCE = 11.0
MIN_UNIT = 6
#: Coverage and evidence from which a whole block is learnt from, and how often.
LEARN_COVERAGE, LEARN_EVIDENCE, ROUNDS = 0.5, 10.0, 2
_CLIP, _UNSEEN = 4.0, -0.5

# A grammar of what web sites, programs and templates say, in words of our own; (a|b) are alternatives, ⟨ and ⟩ are round brackets.
NOTICES = """
(Please|You need to|You have to|To go on, please|In order to view this page, please) (enable|turn on|switch on|activate|allow) (JavaScript|javascript|JS|scripts|scripting|client scripts|cookies|JavaScript and cookies) (in your browser|in the settings of your browser|and reload this page|to use this site|to view the content|to continue|).
(JavaScript|Scripting|Script support|Javascript) (is disabled|is turned off|is not enabled|is switched off|is required|is blocked|must be enabled|has to be on) (in your browser|for this website|on this page|to display this page|).
(This website|This page|This document|The viewer|The site|This app|Our service|The reading view|This content) (requires|needs|works only with|does not work without|cannot be displayed without|can be shown only with|uses) (JavaScript|scripts|a browser with JavaScript|a modern browser|cookies|scripting|client-side scripting|client-side scripts) (to work properly|to be enabled|, which is turned off|).
Your browser (does not support|has disabled|is blocking) (JavaScript|scripts|this content|cookies).
(Checking|We are checking|Please stand by while we are checking) (your browser|if the connection is secure|that you are not a robot|your connection) (before you can access the page|before proceeding|, this may take some seconds|...|).
(Verify|Verifying|Please verify|Confirm) that you are (human|not a robot|a human being) (to continue|by completing the task below|, this takes a second|...|).
(One moment|Just a second|Please wait|Hold on)(, please|while the page is loading|, you will be redirected|...|).
(Captcha|Security check) (failed|required|expired). (Try again|Please reload).
(The|This) (page|document|file|resource|item|URL|address|paper|figure) (you requested|you are looking for|you were looking for|that was requested|) (was not found|could not be found|cannot be located|does not exist|is no longer available|has been moved|was removed|may have been deleted|is not available) (on this server|on our site|at this address|or has moved|right now|).
(Sorry|We're sorry|We are sorry|Unfortunately|Oops|Whoops|We apologise|Apologies)(, |! |: )(something went wrong|an error occurred|an unexpected error has occurred|we could not load this page|the page cannot be displayed|this content is not available|there was a problem with your request|the service is down) (while processing your request|while loading the content|).
(You do not have|You don't have|No) (permission|access|authorization) to (view|access|open|see) this (page|resource|document|file|server).
(Access|Permission) (denied|to this page is denied|to the resource is forbidden|has been blocked) (for your IP address|from your network|).
(Your session|The session|Your login|Your token) (has expired|expired|has timed out|is no longer valid)(; please sign in again|. Please log in again|, you need to log in once more|).
(Please try again|Try again|Please retry|Please come back|Try to reload the page) (later|in a few minutes|in some minutes|shortly|).
(Contact|Please contact|If the problem persists, contact) (the administrator|the site owner|support|our help desk|the webmaster|the operator of the site).
(Return|Go back|Back) to (the home page|the homepage|the start page|the main page|the previous page) (or use the search|or try a search|).
Home | (About|Contact|Help|Search|Login) | (Search|Sitemap|Privacy|Imprint).
(Request|Reference|Error|Incident|Ray|Trace|Support) (ID|id|number|code)(: |  )[a1b2c3d4|7f3a9c21|e4d909c2|9b8x7k2m|q4w8z1r6].
(Error|ERROR|Failure|Fatal error|Warning|Exception|error)(: | )(request|connection|upload|the model|the request|image processing|response|the API call|decoding|the backend|the upstream server) (failed|timed out|was refused|returned an error|returned no data|was reset|was empty|could not be completed|is invalid|exceeded the rate limit) (after 30 s|after 3 retries|with status code 500|⟨attempt 2 of 5⟩|[code 7]|, try again later|).
(Too many requests|Rate limit exceeded|Quota exceeded|Rate limit reached|Request throttled)(, please slow down|. Retry later|, try later|).
(could not|cannot|unable to|failed to) (decode|load|open|read|parse|fetch|process|reach) (the image|image data|the payload|the file|the input|the server|the endpoint|response|the document|the store).
(no response|empty response|no answer|invalid response|invalid header|bad response) (from the server|received from upstream|from the endpoint|body).
(|[|<|⟨)(Insert|Enter|Type|Add|Write|Paste|Put|Fill in|Provide) (your|the|a short|an|some|) (title|text|name|abstract|summary|caption|description|figure caption|section title|content|main result|conclusion|author names|keywords) (here|in this field|in the box|below|before you submit|⟨up to 200 words⟩|)(.|]|>|⟩|)
(Your|Paper|Document|Article|Main|Chapter|Section|Subsection) (title|heading|name|text|subtitle) (here|goes here|⟨use the style⟩|).
(Click|Tap|Double-click) (here |)to (add|edit|insert|enter) (text|a title|a subtitle|content|notes).
(Title|Text|Name|Content|Abstract|Caption|Description|Image|Your text) (goes here|will go here|comes here|to be added|to be completed|to be provided|to be supplied|coming soon|to follow|pending|not yet available).
(First|Second|Third|Given) (Author|Name|Surname)(, | and )(Second Author|Affiliation|Institution|Department)(, City, Country|, University, City, Country|, email|).
Author (Name|One|1|A), (Affiliation|University|Department|Institution), (City|Town), (Country|State).
(Keyword|Term|Item|Topic|Author) (one|1), (keyword|term|item|topic|author) (two|2), (keyword|term|item|topic|author) (three|3).
(This is|Here is|Below is) (a sample|an example|a dummy|some placeholder|filler|a template) (text|paragraph|sentence|heading)(; remove it before you submit|, please delete it|. Replace it with your own|).
(Replace|Delete|Remove|Overwrite) this (text|paragraph|line|section|sentence) (with your own|with your content|before submission|before submitting|).
(No|There is no) (description|caption|title|abstract|content|text|image|summary|data) (available|provided|given|found|was supplied) (for this item|for this image|for image_01|).
(To be|Still to be) (announced|determined|defined|decided|completed|written|added).
(names|authors|details) (withheld|omitted|hidden) (for review|until acceptance|until submission|for blind review).
"""
TRANSLATED = """
Bitte (aktivieren|erlauben) Sie (JavaScript|Skripte|Cookies) in Ihrem Browser(, um diese Seite anzuzeigen|, um fortzufahren|).|(Die Seite|Die angeforderte Seite|Das Dokument) (wurde nicht gefunden|existiert nicht|ist nicht verfügbar).|Ein Fehler ist aufgetreten.|Bitte versuchen Sie es später erneut.|Bitte überprüfen Sie die (Adresse|Eingabe).|Zugriff verweigert.|Hier (steht|kommt) (später der|Ihr) Text (dieses Abschnitts|dieser Seite|hinein).|Dies ist ein Blindtext.|Platzhalter für den Text.
(Page|Adresse|Fichier) (introuvable|inconnue|non trouvée)(, revenez à la page d’accueil|. Retour à l’accueil|).|Veuillez (activer|autoriser) (JavaScript|les scripts|les cookies) (dans|de) votre navigateur(, puis rechargez la page| pour afficher ce contenu| pour continuer|).|(La page|Cette page|Le document) (demandée est introuvable|n’existe pas|est introuvable).|Une erreur est survenue.|Veuillez réessayer plus tard.|Accès refusé.|Retour à la page d’accueil.|Texte à compléter ici.
(Active|Habilite|Por favor, active) JavaScript (en su navegador|para ver esta página|para ver el contenido|para continuar).|La página (solicitada|que busca) no (existe|se ha encontrado|está disponible).|Se ha producido un error.|Inténtelo de nuevo más tarde.|Acceso denegado.|Escriba aquí el texto.
(Ative|Habilite|Por favor, ative) o JavaScript (no seu navegador|para ver esta página|para ver o conteúdo|para continuar).|A página (solicitada|que procura) não (existe|foi encontrada|está disponível).|Ocorreu um erro.|Tente novamente mais tarde.|Acesso negado.
Attivare JavaScript (nel browser|per visualizzare questa pagina).|La pagina (richiesta|cercata) non (esiste|è stata trovata).|Si è verificato un errore.|Accesso negato.
(Пожалуйста, включите|Включите|Разрешите) (JavaScript|скрипты) (в браузере|, чтобы просмотреть эту страницу|, чтобы продолжить|).|(Страница|Запрошенная страница) (не найдена|не существует|удалена|недоступна).|Произошла ошибка.|Повторите попытку позже.|Доступ запрещён.|Вернитесь на главную страницу.|Введите текст здесь.
(Włącz|Proszę włączyć) (JavaScript|obsługę skryptów) (w przeglądarce|, aby wyświetlić tę stronę|, aby kontynuować|).|(Strona|Żądana strona) (nie istnieje|nie została odnaleziona|jest niedostępna).|Wystąpił błąd.|Spróbuj ponownie później.|Brak dostępu.
请(启用|开启|打开)(JavaScript|脚本|浏览器的脚本功能)(以继续浏览|以查看此页面|后重试|)。|(您访问的|您请求的|)(页面|网页|文档)(不存在|未找到|已被删除|无法访问)(，请检查网址|，请返回首页|)。|发生错误，请稍后再试。|访问被拒绝。|在此输入(文字|标题|内容)。
(JavaScript|スクリプト)を(有効にしてください|オンにしてください)。|この(ページ|サイト|文書)を(表示|閲覧|利用)するには、(JavaScript|スクリプト)を有効に(する必要があります|してください)。|(お探しの|)ページ(は存在しません|は見つかりませんでした|が見つかりません)。|エラーが発生しました。|アクセスが拒否されました。|ここにテキストを入力してください。
(자바스크립트|JavaScript|스크립트)를 (활성화|사용)(해 주세요|하도록 설정하십시오).|(요청하신|이) (페이지|문서)를 (찾을 수 없습니다|표시할 수 없습니다).|오류가 발생했습니다.|나중에 다시 시도해 주세요.|접근이 거부되었습니다.
(يرجى|الرجاء) (تفعيل|تشغيل) (جافا سكريبت|البرامج النصية) (في متصفحك|لعرض هذه الصفحة|للمتابعة|).|(الصفحة|الصفحة المطلوبة) (غير موجودة|غير متاحة|لم يتم العثور عليها).|حدث خطأ ما.|يرجى المحاولة لاحقا.|تم رفض الوصول.
कृपया (जावास्क्रिप्ट|JavaScript) (सक्षम|चालू) करें।|(पृष्ठ|पेज) (नहीं मिला|उपलब्ध नहीं है)।|त्रुटि हुई।|โปรดเปิดใช้งาน JavaScript|ไม่พบหน้าที่ต้องการ|เกิดข้อผิดพลาด
"""
#: The usual words of Latin filler.
LATIN_FILLER = (
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum "
    "vivamus sagittis lacus vel augue laoreet rutrum faucibus cras mattis purus maecenas faucibus mollis interdum donec ullamcorper metus auctor fringilla vestibulum ligula porta felis euismod semper aenean lacinia bibendum nullam quam venenatis integer posuere erat ante dapibus pellentesque habitant morbi tristique senectus netus malesuada fames ac turpis egestas praesent ornare sapien vitae massa ultrices pretium mauris risus tortor lectus cursus sodales viverra blandit suspendisse potenti phasellus condimentum gravida nibh hendrerit"
)
#: Classes of characters that a residue of any wording has: unfilled fields, and words that are repeated.
FIELD, AGAIN = "\ue010", "\ue011"
_FIELDS = re.compile(
    r"\{\{\s*[^{}\n]{1,40}?\s*\}\}|\$\{[^{}\n]{1,40}\}|<%=?[^%\n]{1,40}%>|\[\[\s*[\w. -]{1,40}\]\]|@@[\w.-]{1,40}@@|%%[\w.-]{1,40}%%|%\([\w.]{1,30}\)[sdif]|__[A-Z][A-Z0-9_]{2,30}__|(?<![\\\w}])\{[A-Za-z][\w.]{2,30}\}|\[object Object\]|#\{[\w.]{1,30}\}"
)
_AGAIN = re.compile(r"(?<!\w)(?:([^\W\d_]{2,20})(?:[ ,.]{1,3}\1(?!\w)){2,}|([^\W\d_]{2,20} [^\W\d_]{2,20})(?: \2(?!\w)){2,})[ .]*", re.I)


def _repeats(text: str) -> bool:
    """Whether a word or a pair of words stands twice in a row: necessary for _AGAIN, and quicker."""
    words = text.split()
    if any(map(eq, words, words[1:])):
        return True
    pairs = list(zip(words, words[1:], strict=False))
    return any(map(eq, pairs, pairs[2:]))


def classed(text: str) -> str:
    """The text in lower case with unfilled fields and repeated words written as their classes, of the same length."""
    low = text.lower() if len(text.lower()) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    if "{" in text or "[[" in text or "@@" in text or "%" in text or "__" in text or "[o" in text:
        for m in _FIELDS.finditer(text):
            low = low[: m.start()] + FIELD * len(m.group()) + low[m.end() :]
    for m in _AGAIN.finditer(low) if _repeats(low) else ():
        low = low[: m.start()] + AGAIN * len(m.group()) + low[m.end() :]
    return low


def _spelled(phrase: str, rng: random.Random) -> str:
    """One choice among the alternatives of a phrase; brackets that are part of it have no bar inside."""
    while m := re.search(r"\(([^()]*\|[^()]*)\)", phrase):
        phrase = phrase[: m.start()] + rng.choice(m.group(1).split("|")) + phrase[m.end() :]
    phrase = re.sub(r"\s+([.,;])", r"\1", re.sub(r"\s+", " ", phrase)).strip()
    return phrase.replace("⟨", "(").replace("⟩", ")")


def grammar(per_phrase: int = 250, seed: int = 3, leave_out: Callable[[int], bool] = lambda n: False) -> tuple[list[str], list[str]]:
    """(notices and unfilled templates, filler) spelled out from the grammar and from the status and error texts of the system; the same for the same seed.

    Phrases whose number ``leave_out`` names are held out."""
    rng = random.Random(seed)
    phrases = [p for p in NOTICES.strip().split("\n")] + [p for line in TRANSLATED.strip().split("\n") for p in re.split(r"(?<=[.。।])\|(?=[^)]*(?:\(|$))|\|(?=โปรด|ไม่|เกิด)", line)]
    notices: list[str] = []
    for n, p in enumerate(phrases):
        if not leave_out(n):
            alternatives = math.prod(m.count("|") + 1 for m in re.findall(r"\([^()]*\)", p))
            notices += [_spelled(p, rng) for _ in range(min(per_phrase, 2 * alternatives))]
    for s in HTTPStatus:
        if s >= 400:
            notices += [f"{s.value} {s.phrase}", f"Error {s.value}: {s.phrase}", f"HTTP {s.value} - {s.phrase}", f"HTTP Error {s.value}. {s.phrase}.", f"{s.phrase} ({s.value}).", s.description or s.phrase] * 8
    notices += [f"{a}{os.strerror(e)}{b}" for e in errno.errorcode for a, b in (("Error: ", ""), ("", "."), ("ERROR ", " (attempt 1 of 3)"))]
    leads = ("this figure shows ", "in this section, ", "title: ", "abstract of ", "results for ", "", "", "", "")
    notices += [f"{rng.choice(leads)}{FIELD * rng.randint(5, 24)}{rng.choice(('', '.', ' and ' + FIELD * rng.randint(5, 20)))}" for _ in range(1500)]
    words = LATIN_FILLER.split()
    filler = [" ".join(rng.choice(words) for _ in range(rng.randint(3, 14))) + "." for _ in range(4000)]
    filler += [f"{rng.choice(('', 'start: ', 'abstract: '))}{AGAIN * rng.randint(12, 120)}" for _ in range(400)]
    return notices, filler


_FENCED = re.compile(r"```.*?(?:```|\Z)", re.S)
_BREAK = np.zeros(0x3100, bool)
_BREAK[[ord(c) for c in ".!?…।؟。"]] = True
_IDEOGRAPHIC_STOP = (0x3002, 0xFF01, 0xFF1F)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _grams(cp: np.ndarray) -> list[np.ndarray]:
    """Hashes of the n-grams of each order that start at each position; the last ones run past the end into spaces."""
    x = np.concatenate([cp, np.full(N - 1, 32, np.uint32)])
    x[(x >= 0x30) & (x <= 0x39)] = 0x30
    x[(x == 10) | (x == 9) | (x == 0xA0)] = 32
    h, out = x[: len(cp)].copy(), []
    with np.errstate(over="ignore"):
        x *= np.uint32(0x9E3779B1)
        for k in range(1, N):
            h *= np.uint32(0x01000193)
            h ^= x[k : len(cp) + k]
            if k + 1 in ORDERS:
                g = h ^ (h >> np.uint32(15))
                g *= np.uint32(0x85EBCA6B)
                out.append(g >> np.uint32(32 - BITS))
    return out


#: What parts texts that are counted or scored together: no n-gram that matters reaches into the next text.
_PARTED = "\n" * (N + 1)


def _counts(texts: Iterable[str]) -> np.ndarray:
    """Counts of the n-grams of each order; those of two lists of texts add up to those of both."""
    low = [classed(t) + _PARTED for t in texts]
    cp = _codes("".join(low))
    counted, ends = np.ones(len(cp), bool), np.cumsum([len(t) for t in low], dtype=np.int64)
    for k in range(1, N):
        counted[ends - k] = False
    return np.stack([np.bincount(g[counted], minlength=1 << BITS) for g in _grams(cp)])


class Model:
    """Log-likelihood ratio per n-gram, of residue against prose; a table for each order."""

    def __init__(self, tables: np.ndarray):
        self.tables = tables

    @classmethod
    def fit(cls, prose: list[str], leave_out: Callable[[int], bool] = lambda n: False) -> Model:
        """Fit on the grammar and prose."""

        def learn(model: Model) -> tuple[np.ndarray, np.ndarray]:
            blocks, whole, clean = model.learnt(prose)
            return _counts(blocks), _counts(clean) - _counts(whole)

        return cls.fitted(_counts(prose), learn, leave_out)

    @classmethod
    def fitted(cls, prose: np.ndarray, learn: Callable[[Model], tuple[np.ndarray, np.ndarray]], leave_out: Callable[[int], bool] = lambda n: False) -> Model:
        """Fit on the grammar and the counts of the prose, then again with what the fit before takes for residue on the other side.

        ``learn`` gives the counts of the distinct blocks that a model takes for residue, and the change of the counts of the prose without them."""
        notices, filler = grammar(leave_out=leave_out)
        fixed, fill = _counts(notices), _counts(filler)
        model = cls(_ratio([fixed, fill], prose))
        for _ in range(ROUNDS):
            learnt, change = learn(model)
            scale = max(1.0, 0.25 * fixed[0].sum() / max(1.0, learnt[0].sum()))
            model = cls(_ratio([fixed + scale * learnt, fill], prose + change))
        return model

    def learnt(self, texts: list[str]) -> tuple[set[str], list[str], list[str]]:
        """(whole blocks that score as residue, texts with residue, the same texts without it)."""
        blocks, whole, clean = set(), [], []
        for text, spans in zip(texts, self.score(texts, LEARN_COVERAGE, LEARN_EVIDENCE), strict=True):
            at, kept = 0, []
            for a, b, *_ in spans:
                kept.append(text[at:a])
                at = b
                if not text[:a].rstrip(" ") or text[:a].rstrip(" ").endswith("\n\n"):
                    blocks.add(re.sub(r"\d+", "0", text[a:b].strip()))
            if spans:
                whole.append(text)
                clean.append(" ".join([*kept, text[at:]]))
        return blocks, whole, clean

    def units(self, text: str) -> list[tuple[int, int, float]]:
        """Residue units of one text: (start, end, coverage)."""
        return self.score([text])[0]

    def score(self, texts: list[str], coverage: float = COVERAGE, least: float = MIN_EVIDENCE) -> list[list[tuple[int, int, float]]]:
        """Residue units of each text; all texts are scored as one array."""
        low = [classed(t) for t in texts]
        cp = _codes(_PARTED.join(low))
        if not len(cp):
            return [[] for _ in texts]
        begins = np.cumsum([0, *(len(t) + len(_PARTED) for t in low)])
        ratio = sum(t[g] for g, t in zip(_grams(cp), self.tables, strict=True)) / np.float32(len(ORDERS))
        for at, t in zip(begins, low, strict=False):
            if "```" in t:
                for m in _FENCED.finditer(t):
                    ratio[at + m.start() : at + m.end()] = -_CLIP
        # units: after a blank line, and after a terminator before white space
        space = (cp == 32) | (cp == 10) | (cp == 9) | (cp == 0xA0) | (cp == 0x3000)
        nl = cp == 10
        stop = _BREAK[np.minimum(cp, 0x30FF)]
        after = np.flatnonzero((nl[1:] & nl[:-1]) | (stop[:-1] & space[1:]) | np.isin(cp[:-1], _IDEOGRAPHIC_STOP)) + 1
        starts = np.unique(np.concatenate([[0], after, begins[1:-1]]))
        starts = starts[starts < len(cp)]
        ends = np.append(starts[1:], len(cp))
        # n-grams that run out of a unit say nothing about it
        lengths = ends - starts
        for k in range(1, N):
            ratio[ends[lengths > 2 * N] - k] = 0.0
        total = np.concatenate([[0.0], np.cumsum(ratio, dtype=np.float64)])
        # windows are looked at where the evidence suffices
        hopeful = np.flatnonzero(total[ends] - total[starts] >= least)
        out: list[list[tuple[int, int, float]]] = [[] for _ in texts]
        if not len(hopeful):
            return out
        starts, ends, lengths = starts[hopeful], ends[hopeful], lengths[hopeful]
        first = np.cumsum(lengths) - lengths
        i = np.arange(lengths.sum()) + np.repeat(starts - first, lengths)
        lo, hi = np.maximum(i - WINDOW // 2, np.repeat(starts, lengths)), np.minimum(i + WINDOW // 2 + 1, np.repeat(ends, lengths))
        mean = (total[hi] - total[lo]) / (hi - lo)
        covered = ((mean > WINDOW_RATIO) & ~space[i]).astype(np.int32)
        solid = np.add.reduceat((~space[i]).astype(np.int32), first)
        share = np.add.reduceat(covered, first) / np.maximum(solid, 1)
        owner = np.searchsorted(begins, starts, side="right") - 1
        sizes = np.array([len(t.strip()) for t in low])
        bad = (share >= coverage) & ((solid >= MIN_UNIT) | (solid >= 0.8 * sizes[owner]))
        for u in np.flatnonzero(bad):
            d = int(owner[u])
            out[d].append((int(starts[u] - begins[d]), int(min(ends[u] - begins[d], len(texts[d]))), float(share[u])))
        return out


def _ratio(residue: list[np.ndarray], prose: np.ndarray) -> np.ndarray:
    """Larger of the ratios of the residue models; n-grams that no model knows speak slightly against residue."""
    alpha, size = 0.05, float(1 << BITS)
    share = lambda c: np.log((c + alpha) / (c.sum(axis=1, keepdims=True) + alpha * size))
    best = np.max([share(c) for c in residue], axis=0) - share(prose)
    seen = np.max(residue, axis=0) > 0
    return np.where(seen, np.clip(best, -_CLIP, _CLIP), np.where(prose > 0, -_CLIP, _UNSEEN)).astype(np.float32)


#: Characters scored as one array.
CHUNK = 400_000
#: Characters counted as one array.
COUNTED = 2_000_000


def _chunks(texts: list[str], most: int) -> Iterator[tuple[int, int]]:
    """Stretches of the texts, of at most so many characters or of one text."""
    lo = 0
    while lo < len(texts):
        hi, size = lo, 0
        while hi < len(texts) and (hi == lo or size + len(texts[hi]) < most):
            size += len(texts[hi])
            hi += 1
        yield lo, hi
        lo = hi


def _rows(counts: np.ndarray) -> pd.DataFrame:
    """Rows (gram, n) of the counts that are not 0; the orders follow one another."""
    flat = counts.ravel()
    at = np.flatnonzero(flat)
    return pd.DataFrame({"gram": at.astype(np.int32), "n": flat[at]})


def _summed(rows: DataFrame) -> np.ndarray:
    """The counts of rows (gram, n): at most as many sums as there are n-grams, so the array has a fixed size."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"gram": [pdf["gram"].to_numpy(np.int32).tobytes()], "n": [pdf["n"].to_numpy(np.int64).tobytes()]})

    flat = np.zeros(len(ORDERS) << BITS, np.int64)
    for r in rows.groupBy("gram").agg(F.sum("n").alias("n")).mapInPandas(pack, "gram binary, n binary").collect():
        flat[np.frombuffer(r["gram"], np.int32)] = np.frombuffer(r["n"], np.int64)
    return flat.reshape(len(ORDERS), -1)


def gram_counts(texts: DataFrame) -> np.ndarray:
    """Counts of the n-grams of each order over all rows of column ``_t``."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = np.zeros((len(ORDERS), 1 << BITS), np.int64)
        for pdf in batches:
            texts = pdf["_t"].tolist()
            for lo, hi in _chunks(texts, COUNTED):
                n += _counts(texts[lo:hi])
        yield _rows(n)

    return _summed(texts.select("_t").mapInPandas(count, "gram int, n long"))


def fit_model(texts: DataFrame) -> Model:
    """The model fitted on all rows of column ``_t``: the same as :meth:`Model.fit` of their list."""
    texts = texts.select("_t").where("_t is not null and _t <> ''")

    def learn(model: Model) -> tuple[np.ndarray, np.ndarray]:
        shared = texts.sparkSession.sparkContext.broadcast(model.tables)

        def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            m, change = Model(shared.value), np.zeros((len(ORDERS), 1 << BITS), np.int64)
            whole: list[str] = []
            clean: list[str] = []
            for pdf in batches:
                part = pdf["_t"].tolist()
                for lo, hi in _chunks(part, CHUNK):
                    blocks, with_residue, without = m.learnt(part[lo:hi])
                    if blocks:
                        yield pd.DataFrame({"gram": np.int32(-1), "n": 0, "block": sorted(blocks)})
                    whole += with_residue
                    clean += without
                    if sum(map(len, whole)) >= COUNTED:
                        change += _counts(clean) - _counts(whole)
                        whole, clean = [], []
            yield _rows(change + _counts(clean) - _counts(whole)).assign(block=None)

        seen = cut_lineage(texts.mapInPandas(find, "gram int, n long, block string"))
        blocks = seen.where("block is not null").select(F.col("block").alias("_t")).distinct()
        return gram_counts(blocks), _summed(seen.where("block is null").select("gram", "n"))

    return Model.fitted(gram_counts(texts), learn)


def residue_units(df: DataFrame, keys: list[str], text: str, model: Model) -> DataFrame:
    """Rows (keys..., residue_units, residue_share) for the texts with residue: the units as (start, end) and the share of the text they make up."""
    shared = df.sparkSession.sparkContext.broadcast(model.tables.astype(np.float16))  # a table of fixed size
    schema = ", ".join(f"_k{i} {df.schema[k].dataType.simpleString()}" for i, k in enumerate(keys))

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = Model(shared.value.astype(np.float32))
        for pdf in batches:
            texts = pdf["_t"].tolist()
            for lo, hi in _chunks(texts, CHUNK):
                found = m.score(texts[lo:hi])
                rows = [lo + n for n, u in enumerate(found) if u]
                if rows:
                    out = pdf.iloc[rows].drop(columns="_t")
                    units = [found[r - lo] for r in rows]
                    out["residue_units"] = [[{"start": a, "end": b} for a, b, _ in u] for u in units]
                    out["residue_share"] = [min(1.0, sum(b - a for a, b, _ in u) / max(1, len(texts[r]))) for r, u in zip(rows, units, strict=True)]
                    yield out

    found = (
        df.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(text).alias("_t"))
        .where("_t is not null and _t <> ''")
        .mapInPandas(find, f"{schema}, residue_units array<struct<start: int, end: int>>, residue_share double")
    )
    return found.select(*[F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)], "residue_units", "residue_share")


def without_residue(df: DataFrame, keys: list[str], found: DataFrame, most: float = 0.0) -> DataFrame:
    """Rows of ``df`` of which residue makes up at most the share ``most``; rows with null keys stay.

    The keys that go are written and counted: few are sent to the rows, more are joined by a shuffle."""
    drop = found.where(F.col("residue_share") > most).select(*[F.col(k).alias(f"_f{i}") for i, k in enumerate(keys)]).distinct()
    drop = broadcast_if_small(cut_lineage(drop))
    same: Column = F.lit(True)
    for i, k in enumerate(keys):
        same = same & (df[k] == drop[f"_f{i}"])
    return df.join(drop, same, "left_anti")
