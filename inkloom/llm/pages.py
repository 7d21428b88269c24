"""What a line of a page looks like: signs shared by the operators on pages.

A line's kind is read from its shape (links, separators, list marks, sentence
ends) and from cue words of page chrome and of failed pages in the languages of
the corpus.
"""

from __future__ import annotations

import functools
import re

import ahocorasick

# Cue words, as they stand in lower case with digits as 0.  ^ and $
# bind a cue to the start and end of a line.
BYLINE = ["^作者：", "^来源：", "^文 / ", "^文：", "^文/", "^记者", "^编辑：", "^责任编辑", "发布时间：0", "^posted by ", "^written by ", "^автор: ", "^लेखक: ", "^0-0-0 |", "^0-0-0 ｜", "^text: ", "^escrito por ", "^publicado por ", "^scritto da ", "^redazione ", "^글쓴이", "^기자 "]
SERIES = ["^编者按", "^本系列", "^系列第0", "^series note", "^series 0", "^série 0", "^reihe 0", "^serie 0", "^серия 0", "^цикл 0", "^連載", "^シリーズ", "^特集", "^श्रृंखला", "^शृंखला", "^लेखमाला"]
RELATED = ["相关阅读", "猜你喜欢", "热门文章", "延伸阅读", "推荐阅读", "you may also like", "most read", "related articles", "les plus lus", "à lire aussi", "mehr zum thema", "meistgelesen", "関連記事", "人気の記事", "और पढ़ें", "सबसे ज़्यादा पढ़े गए", "लोकप्रिय लेख", "संबंधित लेख", "читайте также", "популярное", "по теме", "самое читаемое", "también te puede interesar", "artículos relacionados", "lo más leído", "potrebbe interessarti", "articoli correlati", "i più letti", "leia também", "artigos relacionados", "mais lidas", "관련 기사", "많이 본 기사", "추천 기사"]
INLINE = ["^广告", "^sponsored", "^publicité", "^anzeige", "^реклама", "^विज्ञापन", "^広告", "立即咨询$", "^资料下载：", "^get the paper", "^télécharger", "^herunterladen", "^whitepaper", "^скачать", "^डाउनलोड करें", "^資料ダウンロード", "（pdf，0", "(pdf, 0", "^标签：", "^tags:", "^mots-clés", "^schlagwörter", "^теги", "^метки", "^टैग", "^タグ", "^上一篇", "^下一篇", "^previous:", "^next:", "^précédent", "^suivant :", "^zurück:", "^weiter:", "^назад:", "^далее:", "^पिछला:", "^अगला:", "^前の記事", "^次の記事", "^前へ", "^次へ", "^网友", "^reader no. 0", "^lecteur n", "^leser nr", "^читатель", "^読者", "^पाठक", "[0楼]", "^您的位置", "^you are here", "^vous êtes ici", "^sie sind hier", "^вы здесь", "^現在地", "^आप यहाँ", "^publicidad", "^patrocinado", "^pubblicità", "^publicidade", "^etiquetas:", "^tag:", "^anterior:", "^siguiente:", "^precedente:", "^successivo:", "^seguinte:", "^está aquí", "^sei qui", "^você está aqui", "^광고", "^태그", "^이전 글", "^다음 글"]
FOOT = ["服务热线", "书面授权", "法律声明", "收藏 0", "转发 0", "备案号", "转载请注明", "版权所有", "点个赞吧", "已有0人点赞", "^觉得有用", "扫码关注", "^©", "^(c) 0", "the views above are those", "^分享到", "reproduction without written", "^shared 0", "rights reserved", "legal notice", "周报，每周0篇", "^sign up for the", "投资建议", "^share this", "^share:", "^partag", "newsroom, desk", "terms of use apply", "^follow ", "rate this page", "tous droits", "reproduction interdite", "mentions légales", "s'abonner à", "newsletter von", "nachdruck nur", "alle rechte", "meinung des autors", "^teilen", "artikel teilen", "0 mal geteilt", "impressum", "datenschutz", "この記事をシェア", "^いいね 0", "会社概要", "無断転載", "メールマガジン", "個人の見解", "поделиться", "подписаться на", "все права", "перепечатка", "साझा करें", "सर्वाधिकार", "न्यूज़लेटर", "गोपनीयता", "todos los derechos", "tutti i diritti", "todos os direitos", "모든 권리", "aviso legal", "note legali", "política de privacidad", "informativa sulla privacy", "política de privacidade", "개인정보", "무단 전재", "^suscríbete", "suscríbete hoy", "^iscriviti", "^assine ", "^inscreva-se", "뉴스레터", "^compartir", "^condividi", "^compartilh", "^공유", "boletín"]
SCRIPTS = ["请启用 javascript 以获得", "请启用javascript以获得", "please enable javascript for", "^veuillez activer javascript$", "bitte javascript aktivieren", "^javascript を有効にしてください", "^включите javascript", "कृपया javascript चालू", "active javascript para", "attiva javascript per", "ative o javascript para"]
CONSENT = ["本站使用 cookie", "接受全部 cookie", "仅限必要", "保存信息，可随时", "we use cookies", "accept all |", "reject all", "your privacy matters", "manage your choices", "tout accepter", "tout refuser", "dépose des cookies", "seite verwendet cookies", "alle akzeptieren", "alle ablehnen", "クッキーを使用します", "すべて許可", "файлы cookie", "использует cookie", "принять вс", "вы соглашаетесь", "कुकी", "सभी स्वीकार", "继续访问即表示同意", "by browsing on you agree", "poursuivre vaut accord", "mit der nutzung stimmen sie zu", "閲覧を続けると同意", "продолжая", "आगे बढ़ने पर", "utilizamos cookies", "usamos cookies", "aceptar todo", "rechazar todo", "utilizziamo i cookie", "accetta tutto", "rifiuta tutto", "aceitar tudo", "쿠키를 사용", "모두 수락"]
FAILED = [
    # errors, blocks, logins, maintenance
    "^0 not found", "^0 bad gateway", "^0 service", "^0 forbidden", "^0 internal server error", "^0 gateway time", "^0 unauthorized", "^0 too many", "page you requested could not", "page not found", "link has gone missing", "was removed by its publisher", "^access denied", "do not have permission", "too many requests", "verify you are human", "checking your browser", "session expired", "sign in again", "sign in to continue", "log in to continue", "upstream timed out", "error establishing a database", "something went wrong", "down for maintenance", "under maintenance", "start page or contact", "^reference 0$", "^error 0$", '{"code": 0',
    "页面不存在", "已删除或地址有误", "内容走丢了", "该文章已下线", "请求被拦截", "访问过于频繁", "会话已过期", "数据库连接失败", "服务器开小差", "系统维护中", "^错误码 0", "返回首页或联系管理员", "没有权限", "无权访问", "请先登录", "请重新登录", "网关超时", "登录后继续", "登录后查看",
    "page introuvable", "cette adresse n'existe plus", "accès refusé", "site en maintenance", "réessayer plus tard", "^erreur 0$", "vous connecter pour", "vous reconnecter",
    "seite nicht gefunden", "adresse existiert nicht", "zugriff verweigert", "wartungsarbeiten", "versuchen sie es später", "^fehler 0$", "bitte melden sie sich",
    "ページが見つかりません", "お探しの記事は削除", "アクセスが拒否され", "メンテナンス中です", "^エラー 0", "ログインしてください",
    "страница не найдена", "доступ запрещ", "доступ закрыт", "^ошибка 0", "технические работы", "попробуйте позже", "повторите попытку", "войдите, чтобы", "материал удал", "адрес не существует", "адрес больше не",
    "पृष्ठ नहीं मिला", "^त्रुटि 0", "बाद में प्रयास", "पहुँच अस्वीक", "रखरखाव", "हटा दिया गया", "लॉगिन करें",
    # scripts in place of the page
    "javascript to run this", "javascript is disabled", "shown without scripts", "scripts may be blocked", "scripting is off", "启用javascript后继续", "启用 javascript 后继续", "需要脚本支持", "禁用脚本", "无响应请打开脚本", "sans scripts", "activez javascript pour", "aktivieren sie javascript, um", "ohne skripte", "有効にしてから再読み込み", "スクリプトが無効", "страницы включите javascript", "скрипты отключены", "देखने के लिए javascript", "स्क्रिप्ट बंद", "स्क्रिप्ट के बिना",
    # filler
    "^lorem ipsum", "your headline here", "short intro in this block", "dummy copy", "text text text", "asdf asdf", "sample text goes here", "test page, please ignore", "loading...", "beispielüberschrift", "見出しが入ります", "本文が入ります", "ここに見出し", "^заголовок$", "शीर्षक यहाँ", "这是一段示例文字", "文字文字文字文字", "测试测试", "默认段落", "请输入文章摘要", "此处为正文", "内容区域占位", "^这里是标题$", "texte d'exemple", "votre titre ici", "faux-texte", "faux texte", "platzhaltertext", "mustertext", "blindtext", "beispieltext", "ダミーテキスト", "この文章は仮", "サンプルテキスト", "текст-заполнитель", "текст-заглушка", "пример текста", "текст для примера", "образец текста", "नमूना पाठ", "पाठ आएगा", "उदाहरण पाठ",
]
# What a notice of a failed page speaks of, and what it says of it.  A
# unit with one of each close together is such a notice in any wording.
THINGS = ["page", "url", "link", "website", "this site", "content", "server", "gateway", "upstream", "access", "request", "connection", "session", "javascript", "cookies", "scripts", "browser", "captcha", "robot", "human", "traffic", "account", "you have been", "subscribers", "página", "pagina", "enlace", "contenido", "contenuto", "conteúdo", "acceso", "accesso", "acesso", "servidor", "servizio", "servicio", "serviço", "navegador", "sesión", "sessione", "sitio", "sito", "seite", "zugriff", "sitzung", "dienst", "accès", "serveur", "navigateur", "страниц", "доступ", "сервер", "сайт", "браузер", "ページ", "アクセス", "サーバー", "ブラウザ", "페이지", "접근", "서버", "브라우저", "로그인", "자바스크립트", "사이트", "页面", "网页", "访问", "服务器", "浏览器", "पृष्ठ", "पेज", "सर्वर"]
STATES = ["not found", "be found", "cannot find", "can't find", "could not find", "couldn't find", "no longer available", "doesn't exist", "does not exist", "no longer exists", "has been removed", "unavailable", "forbidden", "is denied", "been denied", "blocked", "timed out", "timeout", "connect error", "to continue", "must be enabled", "is required to", "please enable", "turn on", "has expired", "not a robot", "are human", "are a human", "unusual", "rate limit", "be right back", "back soon", "overloaded", "please reload", "please log in", "please sign in", "only for subscribers", "no encontrad", "no existe", "no está disponible", "no se pudo", "denegado", "bloquead", "activa javascript", "habilit", "inicia sesión", "vuelve a intentar", "mantenimiento", "non trovata", "non esiste", "non è disponibile", "negato", "bloccat", "attiva javascript", "abilit", "accedi per", "manutenzione", "riprova", "não encontrad", "não existe", "indisponível", "negado", "entre para", "manutenção", "nicht gefunden", "nicht verfügbar", "nicht erreichbar", "verweigert", "abgelaufen", "gesperrt", "introuvable", "indisponible", "refusé", "expiré", "не найден", "недоступ", "запрещ", "не существует", "истек", "見つかりません", "利用できません", "拒否", "有効にして", "찾을 수 없", "존재하지 않", "거부", "차단", "필요합니다", "활성화", "점검 중", "만료", "不存在", "无法访问", "无法打开", "被拒绝", "已过期", "不可用", "नहीं मिला", "उपलब्ध नहीं"]
#: Signs between the two, at most.
NEAR = 48
#: Words of invented Latin that filler is made of.
LATIN = set("lorem ipsum dolor sit amet consectetur adipiscing elit sed eiusmod tempor incididunt labore dolore magna aliqua sagit vesti ultra quaerat consec erat velit isis morbi luctus tetur bulum pretium tis facil porta ornare varius cursus magnis nulla integ tempor".split())

NAV, ITEM, CRUMB, BAR, KEY, BY, SER, REL, INL, FOO, SCR, CON, PROSE, BULLET, HEAD, NUMBER, SHORT, LONG, TABLE, BAD, TITLE = range(21)
KINDS = 21
#: In place of a cue's order: parts of a notice of a failed page.
SAYS, OF = -1, -2
_SPACE, _DIGITS = re.compile(r"[\s\u200b\ufeff]+"), re.compile(r"[0-9]+")
_NAV = re.compile(r"\[[^\]]{1,40}\]\(/[a-z]0\)$")
_ITEM = re.compile(r"(?:[*•›·–-] ?)?\[[^\]]+\]\([^)]*\)$")
_CRUMB = re.compile(r" (?:›|»|>|/|>>|→) ")
_CLOSERS, _ENDS = "”»“」』)）]\"’ ", frozenset(".!?。！？…।؟")
_INNER = re.compile(r"[.!?] [A-ZÀ-ÞА-Я“«„]|[。！？।]")
_MARK = re.compile(r"(?:#{1,6} |[一二三四五六七八九十]+、|0\.0 |[ivx]+\. )")
_NUMBER = re.compile(r"0[.)、．] ?")
_BULLET = re.compile(r"[*•›·–-] ?")
_SIGNED = re.compile(r"(?:by|par|von) [^,]{3,40},? (?:le )?0-0-0")
_WORD = re.compile(r"[a-z]+")


@functools.cache
def _cues(notices: bool = False) -> ahocorasick.Automaton:
    """All cue words in one automaton, with the parts of notices if wanted; a word's
    value: (order, kind, length, bound at start, at end)."""
    auto = ahocorasick.Automaton()
    held: dict[str, list] = {}
    for order, words in ((SAYS, STATES), (OF, THINGS)) if notices else ():
        for w in words:
            held.setdefault(w, []).append((order, None, len(w), False, False))
    for order, (kind, words) in enumerate(((BY, BYLINE), (SER, SERIES), (REL, RELATED), (INL, INLINE), (SCR, SCRIPTS), (CON, CONSENT), (FOO, FOOT), (BAD, FAILED))):
        for w in words:
            start, end = w[0] == "^", len(w) > 1 and w[-1] == "$"
            held.setdefault(w[start : len(w) - end], []).append((order, kind, len(w) - start - end, start, end))
    for w, values in held.items():
        auto.add_word(w, tuple(values))
    auto.make_automaton()
    return auto


def _kind_at(s: str, n: int, at: int, value: tuple) -> tuple[int, int] | None:
    """(order, kind) of a cue that ends at ``at``, if it may stand there."""
    order, kind, length, start, end = value
    if start and at != length - 1 or end and at < n - 1:
        return None
    if kind == REL:
        rest = s[at + 1 :].lstrip()
        if at != length - 1 or rest and rest[0] not in ":：":
            return None
        if len(rest) > 1:
            kind = INL
    return order, kind


def cue_of(s: str) -> int | None:
    """Kind of the first class of cues that occurs in ``s`` = shown(line)."""
    best, n = None, len(s.rstrip(".。!！ "))
    for at, values in _cues().iter(s):
        for v in values:
            if (best is None or v[0] < best[0]) and (k := _kind_at(s, n, at, v)):
                best = k
    return best[1] if best else None


def read_cues(s: str) -> tuple[bool, int | None]:
    """(whether ``s``, a unit as shown(), is a notice of a failed page or filler by its
    words, whatever its length; its cue as cue_of has it).  A notice has a cue, or a
    thing and what is said of it."""
    best, n, things, states = None, len(s.rstrip(".。!！ ")), [], []
    failed = False
    for at, values in _cues(True).iter(s):
        for v in values:
            order, kind, length = v[:3]
            if order == OF:
                if not (at >= length and s[at - length].isascii() and s[at - length].isalnum() and s[at - length + 1].isascii()):
                    things.append((at - length + 1, at + 1))
            elif order == SAYS:
                states.append((at - length + 1, at + 1))
            elif k := _kind_at(s, n, at, v):
                failed = failed or kind == BAD
                if best is None or order < best[0]:
                    best = k
    failed = failed or bool(states) and any(a < d + NEAR and c < b + NEAR and (b <= c or d <= a) for a, b in things for c, d in states)
    return failed, best[1] if best else None


def shown(line: str) -> str:
    """A line as it is compared: one blank for white space, lower case, digits as 0."""
    return _DIGITS.sub("0", _SPACE.sub(" ", line).strip().lower())


#: White space that is not one plain blank already; blanks beside a line feed.
_BLANKS, _EDGES = re.compile(r"[^\S\n ][^\S\n]*| [^\S\n]+|[\u200b\ufeff]+"), re.compile(r" +\n *|\n +")
_NUMBERS = re.compile(r"[1-9][0-9]*|0[0-9]+")


def shown_lines(text: str) -> list[str]:
    """shown() of each line of a text, in one go."""
    return _EDGES.sub("\n", _NUMBERS.sub("0", _BLANKS.sub(" ", text)).lower()).strip(" ").split("\n")


def titled(text: str | None) -> str:
    """A title as it is compared with lines."""
    return shown(text) if text else ""


def is_latin_filler(s: str) -> bool:
    if not s.isascii():
        return False
    words = _WORD.findall(s)
    return len(words) >= 3 and sum(w in LATIN for w in words) >= 0.5 * len(words)


def kind_of(line: str, s: str, title: str = "", cue: int | None = -1) -> int:
    """Kind of a non-blank line; ``s`` is shown(line), ``cue`` its cue if known."""
    if title and s.lstrip("#*• ") == title:
        return TITLE
    n = len(s)
    end = s.rstrip(_CLOSERS)[-1:] in _ENDS
    if s[0] == "[":
        if _NAV.match(s):
            return NAV
        if _ITEM.match(s):
            return ITEM
    if n <= 400 and not (end and n > 160):
        cue = cue_of(s) if cue == -1 else cue
        if cue is not None and (n <= 160 or cue == BAD):
            return cue
        if s[0] in "bpv" and _SIGNED.match(s):
            return BY
    if s[0] == "|" and s[-1] == "|":
        return TABLE
    if is_latin_filler(s):
        return BAD
    if end or n > 40 and _INNER.search(line):
        return PROSE
    if n > 140:
        return LONG
    if _ITEM.match(s):
        return ITEM
    if _CRUMB.search(s):
        return CRUMB
    if " | " in s or " ｜ " in s or s.startswith("| "):
        return BAR
    if _MARK.match(s):
        return HEAD
    if _NUMBER.match(s):
        return NUMBER
    if "  " in line.strip() or "\u3000" in line.strip():
        return BAR
    if _BULLET.match(s):
        return BULLET
    return SHORT
