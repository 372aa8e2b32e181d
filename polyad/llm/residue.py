"""Template residue, filler, error pages and script notices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polyad.llm.mixing import source_key
from polyad.plans.session import bounded, cut, need

#: A line is boilerplate if at least MIN_DOCS documents of its host and this share of them have it,
#: or this share of all documents.
MIN_DOCS, MIN_SHARE = 5, 0.0025
#: Real words that may stand around residue.
FEW_WORDS = 20
#: A recurrent line with evidence is the page itself, not boilerplate around a page, if in this
#: share of its documents fewer than OWN_WORDS words of their own stand beside it.
ALONE_SHARE, OWN_WORDS = 0.5, 5
#: Share of a message's words that need not be words of messages.
FOREIGN = 0.17

# --- slots: an opening mark, a name, the mirrored closing mark ---------------------------------
_NAME = r"[A-Za-z_][\w.\-]*"
_WORDS = r"[A-Za-z_0-9][\w.\- |:]{0,58}"
SLOTS = [
    r"\{\{\{?[^{}\n]{1,60}\}\}", r"\{%[^%{}\n]{1,60}%\}", rf"[$#]\{{\s*{_NAME}\s*\}}", r"<%[=-]?[^%\n]{1,60}%>", r"<\?=?[^?\n]{1,60}\?>", rf"\[%\s?{_WORDS}%\]",
    r"(?<![\\\w^}{$#])\{\$?[A-Za-z_0-9.]*\}(?!\})", r"(?<![\w%\"])%\([A-Za-z_]+\)[sd]", r"(?<![\w%])%{1,2}[A-Z_]{3,}%{1,2}", r"(?<![\w%\"])%[sd](?!\w)", rf"\*\|{_NAME}\|\*",
    r"\[\[\s*\w+\s*\]\]", r"\[[A-Z][A-Z_ ]+[A-Z]\]", r"\[(?i:your|insert|enter|add|placeholder) [\w ]{2,40}\]", r"\[[\w ]{2,40} (?i:here|placeholder)\]", r"\[(?:…|\.\.\.)\s?\w+\s?(?:…|\.\.\.)\]", r"\([\w ]{2,40} (?i:goes here)\)",
    r"(?<!\w)__[A-Za-z][A-Za-z_]*?__(?!\w)", r"@@\w+@@", r"##\w+##", r"«\w+»", r"~~\w+~~", r"&lt;[\w ]+&gt;", r"<<\w+>>",
    r"<(?!(?:unk|pad|mask|br|html|body|head|script|style|div|span|table|pre|code|noscript|reason|error|[Ee]nter|title|link|meta|form|input|img|ul|ol|li|tr|td|th|hr|em|strong|sup|sub|section|article|header|footer|nav|main|button|label)>)(?:[A-Za-z_]{2,}|[A-Z][a-z]+ [A-Z][a-z]+)>",
    r"(?<![\\$\w])\$[A-Za-z][A-Za-z_]{2,}\$(?![\w$])", r"\[(?i:object object)\]", r"(?<![\w\"'])(?:NaN|NAN|undefined|UNDEFINED|X{4,}|TBD)(?![\w\"'])", r"@@r \w+@@",
]
# What RE2 can say of the same notations, for the first look at a text.
_SLOT_HINT = "|".join([
    r"\{\{[^{}\n]{1,60}\}\}", r"\{%[^%{}\n]{1,60}%\}", r"[$#]\{\s*[A-Za-z_]", r"<[%?][^%?\n]{1,60}[%?]>", r"\[%\s?\w[^%\n]{0,58}%\]", r"\{\$?[A-Za-z_0-9.]*\}", r"%\([A-Za-z_]+\)[sd]", r"%[A-Z_]{3,}%", r"%[sd]\b", r"\*\|[A-Za-z_][\w.\-]*\|\*",
    r"\[\[\s*\w+\s*\]\]", r"\[[A-Z][A-Z_ ]+[A-Z]\]", r"\[(?i:your|insert|enter|add|placeholder) ", r"(?i: here| placeholder)\]", r"\[(?:…|\.\.\.)\s?\w+\s?(?:…|\.\.\.)\]", r"(?i: goes here)\)",
    r"__[A-Za-z][A-Za-z_]*__", r"@@\w+@@", r"##\w+##", r"«\w+»", r"~~\w+~~", r"&lt;[\w ]+&gt;", r"<<\w+>>", r"<[A-Za-z_]{2,}>", r"<[A-Z][a-z]+ [A-Z][a-z]+>", r"\$[A-Za-z][A-Za-z_]{2,}\$", r"(?i:\[object object\])", r"\b(?:NaN|NAN|undefined|UNDEFINED|X{4,}|TBD)\b", r"`[rR] \w+`",
])
# Sentences that speak about slots or code instead of leaving one open.
MENTION = (
    r"placeholder|platzhalter|template|\bmuster\b|\bmodele\b|plantilla|\btoken\b|\bpattern\b|\bescape\b|vignette|knitted|sprintf|\bglue\(|\bprompt\b|\bshell\b|\bvariables?\b|\bsyntax\b"
    r"|\\frac|\\sum|\"\w+\"\s*:|</(?!s>)\w|layout|is shown as|\b(mean|ratio|division|quotient)\b|returns? (nan|undefined)"
)

# --- messages: words of four languages, folded ---------------------------------------------------
_w = str.split
FUNCTION = frozenset(_w(
    "the of and a an in to is was are were for with by on at be been being as or if it its this that these there you your we our us i me my he they them do does did has have had will would can could may might must should shall so up out but because while "
    "der die das und ist war sind waren ein eine einen einer eines einem des dem den im in zu zum zur von mit auf an es sie ihr ihre ihrer ihren ihnen wir sich als oder wenn um fur beim mehr muss mussen aus bei durch kann konnen wurde wird werden hat haben diese dieser dieses diesen dieser bitte "
    "le la les l d de du des et un une est sont a au aux dans pour par que qui se ce cette cet ces vous votre vos nous en sur s n ou a ete etre avoir pas ne doit doivent "
    "el los las y del al por con para que se su sus este esta estos estas es son un una lo ha han ser usted en o debe deben"
))
#: Function words alone tell a sentence of a language from filler; short list, no overlap with Latin.
SPOKEN = frozenset(_w("the of and a an to is was are were for with by on at be not that this it you we der die das und ist war ein eine des dem den zu von mit nicht auf le la les de du et un une est dans pour par que se el los las y en del al por con no as or"))
THING = frozenset(_w(
    "page pages file url uri document record entry site website web article resource link content service server host connection gateway request requested access archive database item address path account identifier index search domain network upstream application app system viewer reader portal "
    "seite datei dokument eintrag inhalt inhalte dienst server verbindung zugriff adresse webseite website anfrage ressource "
    "fichier contenu serveur connexion acces adresse requete ressource demande demandee "
    "pagina archivo documento contenido servicio servidor conexion acceso direccion sitio recurso solicitado solicitada entrada aufgerufene gewunschte angeforderte looking asked http https store visor explorer clients registro dokuments eintrags inhalts"
))
NEGATION = frozenset(_w("not no cannot can't couldn't doesn't isn't never unable nicht kein keine keinen ne n pas sans no ningun ninguna could fehlt nothing"))
STATE = frozenset(_w(
    "found find exist exists available responding respond reachable reach answer matches match permission allowed authorized authorised valid open opened loaded load connect permitted longer "
    "gefunden existiert erreichbar verfugbar berechtigung berechtigt erlaubt geladen geoffnet antwortet "
    "trouve trouvee existe disponible repondu repond autorise accessible "
    "encontrada encontrado encontro responde existe autorizado permiso cargar"
))
FAILURE = frozenset(_w(
    "error errors unavailable denied forbidden expired timeout failed failure crashed unauthorized unauthorised maintenance oops whoops uh outage gone switched ended upgraded offline exceeded refused wrong removed moved deleted interrupted throttled down "
    "fehler serverfehler verweigert verschoben geloscht abgelaufen wartungsarbeiten wartung gesperrt fehlgeschlagen nichtverfugbar gestort unterbrochen "
    "erreur introuvable indisponible refuse expire expiree deplace deplacee supprime supprimee maintenance interdit echec echoue "
    "error denegado caducado caducada expirado mantenimiento prohibido fallo indisponible movido movida eliminado eliminada"
))
SCRIPT = frozenset(_w("javascript js script scripts scripting cookie cookies browser adblocker adblock blocker robot captcha webbrowser navigateur navegador skript skripte robots human client temoins"))
DEMAND = frozenset(_w(
    "enable enabled activate allow require required requires need needs relies rely disabled disable off blocked blocks block supported support outdated unsupported update upgrade turn switch without necessary needed check checking verify verifying checks use date without "
    "aktivieren aktiviert erlauben erlaubt zugelassen benotigt erforderlich deaktiviert unterstutzt veraltet ohne einschalten zulassen braucht notig pruft "
    "activer activez active activee autorise autoriser autorisez exige necessite requis necessaire desactive obsolete sans pris charge "
    "necesita requiere permitalos permitalas habilite habilitar habilitado permitido activado active activar permita desactivado obsoleto compatible sin necesario"
))
#: The thing written on and what is said of it where text is still to come.
PAPER = frozenset(_w("text texts paragraph abstract summary content title description placeholder absatz zusammenfassung inhalt titel texte paragraphe resume contenu titre texto parrafo resumen contenido titulo"))
TO_COME = frozenset(_w("here goes replace insert sample dummy filler placeholder hier steht ersetzen einfugen beispieltext blindtext ici inserer inserez remplacez remplissage remplacement aqui va inserte sustituya relleno reemplace"))
ALWAYS_FILLER = frozenset(_w("beispieltext blindtext platzhaltertext fulltext loremipsum"))
#: What else messages say.
MANNERS = frozenset(_w(
    "please sorry try again later back go home return start reload refresh retry view read continue sign log login logged session sessions contact administrator admin support webmaster help reference ref code status bad internal unknown unexpected occurred happened encountered problem went something temporarily temporary currently moment soon shortly right down time timed timing long too took many much limit quota daily hour reached hour minutes seconds few while rendering raised processing process loading displayed display shown show order properly correctly work works working features some newer one other another version latest modern device settings all any robot checking that content message following details information only more about typed check spelling mistyped correct entered existing such directory stream line most recent call last are able "
    "run running date looked everywhere behind reading opening searching noscript reason nr turned side oh reloading redirected scheduled performing undergoing institution available your newer whether happens blocks active "
    "spater erneut noch einmal versuchen sie es leider zuruck startseite anmelden melden an sitzung momentan zurzeit vorubergehend derzeit aufgetreten ist ein interner unbekannter um anzeigen anzuzeigen angezeigt dargestellt darstellen werden kann konnen fortzufahren technischer aktive nur alle nutzen verwenden weiter laden "
    "veuillez reessayer ulterieurement plus tard desole retour accueil session interne est survenue inattendue inconnue produite technique afficher consulter continuer cette actuellement momentanement puis recharger rechargez "
    "intentelo de nuevo mas tarde lo sentimos volver inicio sesion iniciar inicie interno se produjo un ha ocurrido inesperado desconocido ver mostrar continuar esta actualmente momento temporalmente fue vuelva entrar"
))
LEXICON = FUNCTION | THING | NEGATION | STATE | FAILURE | SCRIPT | DEMAND | MANNERS
FILLER_LEXICON = FUNCTION | PAPER | TO_COME | ALWAYS_FILLER | frozenset(_w("your own words with will stand later this the text will be added soon spater bitte eigenen worten vos propres mots sus propias palabras goes some any more please real actual"))
# Beginnings of the words of the common filler passage, as it is and as generators vary it.
LATIN = _w("lore lori ipsu ipsa dolo dolu amet amit cons adip elit vest quis phas ferm viva inte cura veli posu augu null dapi maur soda lacu tort orna sitr sedd eius temp inci labo magn aliq enim mini veni nost exer ulla nisi comm susc vulp ligu prae pras")
KEYBOARD = "qwertyuiop asdfghjkl zxcvbnm asdfasdf qwerqwer jkljkl jklo testtest"
# Syntax of stack traces, structured errors and status lines.
TRACES = [
    r"traceback \(most recent", r"^\s*at [\w.$<>]+\(.*\)$", r"^(?:\w+\.)*\w*(?:error|exception)\s*:", r"\"error\"\s*:", r"<error\b", r"\berror in [a-z_.]+\(", r"\b(?:fatal |parse )?(?:warning|error|notice): .* (?:on|at) line \d+", r"failed to open stream", r"^execution halted", r"^segmentation fault", r"^stack ?trace\b",
    r"^(?:error|fehler|erreur|http|http error|http/\d\.\d|status)?\s*:?\s*[45]\d\d\s*(?:[:.!-]|$)", r"^(?:error|fehler|erreur|http|http error|http/\d\.\d)?\s*:?\s*[45]\d\d:? (?:not|bad|forbidden|unauthorized|internal|service|gateway|too|page|access|request)\b",
]
BESIDE = [r"^calls?: ", r"^file \".*\", line \d+", r"^\(?(ref|nr|no)\.", r"^\d+\)", r"^\[?(\.\.\.|…)\]?$", r"^(reference|ref|incident|request|trace) (id )?\W?[\w-]*\d", r"^[-=_*\s]+$"]
# A first look at a text, on folded lower case; every message, trace and filler of the rules below has one.
_MESSAGE_HINT = "|".join([
    r"\b(?:internal|unknown|unexpected|server|fatal|application|database|network|system|runtime|script|unbekannter|interner) error", r"\berrors? (?:has|have|was|occurred|is|while|loading|in|code|\d)", r"error\s*[\"'(:!.>]*[:!>]|<error\b|(?:^|[\n\r])\W*errors?\b", r"\b(?:fehler|serverfehler|erreur|indisponible|introuvable)\b", r"exception\s*:|traceback|\bexecution halted|stack ?trace|segmentation fault|failed to open|(?:warning|notice): .* on line",
    r"(?:^|[\n\r]|http|status|code|[.!?…:] )\W*[45]\d\d\b|\b[45]\d\d\b:? ?(?:not|bad|forb|unau|inter|serv|gate|too|page|acc|req)",
    r"\b(?:unavailable|denied|forbidden|expired|timeout|crashed|unauthori[sz]ed|maintenance|oops|whoops|uh-oh|outage|upgraded|offline|exceeded|refused|went wrong|failed|failure|throttled|interrupted|is gone)\b", r"\b(?:verweigert|abgelaufen|wartung\w*|gesperrt|fehlgeschlagen|gestort|unterbrochen|refuse|expiree?|interdit|echec|echoue|denegado|caducad[oa]|expirado|mantenimiento|prohibido|fallo|movid[oa]|deplacee?|supprimee?|eliminad[oa]|verschoben|geloscht)\b",
    r"\b(?:been|was|is) (?:removed|moved|deleted|switched off)\b", r"\b(?:not|cannot|unable to) (?:be )?(?:found|find|exist|available|responding|respond|reachable|reach|answer|open|opened|loaded|load|connect|have permission|allowed|authori[sz]ed|permitted|able)\b|(?:couldn't|can't|doesn't|isn't) (?:be )?(?:found|find|exist|available|respond|reach|open|load|connect|run)",
    r"\bno \w+ (?:match|matches|found)\b|\bno (?:results?|pages?|records?|entry|entries|documents?|items?|files?|articles?|permission)\b|\bno longer (?:exists?|available|here)", r"nicht (?:mehr )?(?:gefunden|erreichbar|verfugbar|berechtigt|erlaubt|geladen|geoffnet)|existiert nicht|antwortet nicht|fehlt ihnen|keine berechtigung",
    r"(?:n'existe|n'a pas repondu|ne repond|pas (?:trouvee?|disponible|accessible|autorise))|no (?:existe|encontrad|se encontr|responde|esta disponible|autorizad|tiene permiso)|encontro", r"\btoo many\b|\b(?:took|taking) too long\b|\btimed out\b|\btry again\b|\bright back\b|reached the|session (?:has )?ended|\b(?:sign|log) (?:back )?in (?:again )?to\b|versuchen sie|melden sie sich|reessayer|intentelo|inicie sesion",
    r"\b(?:javascript|cookies?|scripts?|scripting|skripte?|browser|navigateur|navegador|captcha|robots?|adblock\w*|client-side)\b", r"(?:^|[\n\r.])\W*loading\b",
])
_PAPERS = "(?:text|texts|paragraph|abstract|summary|content|title|description|absatz|zusammenfassung|inhalt|titel|texte|paragraphe|resume|contenu|titre|texto|parrafo|resumen|contenido|titulo)"
_FILLER_HINT = "|".join([
    rf"\b(?:here|goes|replace|insert|sample|dummy|filler|hier|steht|ersetzen|einfugen|ici|inserer|inserez|remplacez|remplacement|aqui|inserte|sustituya|relleno|reemplace)\b(?:\W+\w+){{0,4}}\W+{_PAPERS}\b", rf"\b{_PAPERS}\b(?:\W+\w+){{0,3}}\W+(?:here|goes|de relleno|de remplissage|ersetzen|einfugen)\b", r"bitte ersetzen|placeholder|beispieltext|blindtext|platzhaltertext",
    r"\b(?:" + "|".join(LATIN) + r")\w*\W+(?:\w+\W+)?(?:" + "|".join(LATIN) + r")\w*\W+(?:\w+\W+)?(?:" + "|".join(LATIN) + ")", r"\b(?:asdf|qwer|zxcv|jkl)", r"\bbla+h?\W+bla", r"\btest\W+test\W+test", r"(?:\b[a-z]\W+){6}", r"xx\W+x|x\W+xx",
])

_INVISIBLE = r"[\x{00AD}\x{200B}-\x{200F}\x{2060}\x{FEFF}]|\p{M}"


def _any(patterns: list[str]) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


def _folded(texts: pa.Array) -> pa.Array:
    """Compatibility forms without accents and invisible characters; case stays."""
    ascii_ = pc.string_is_ascii(texts)
    if not pc.all(ascii_).as_py():
        at = pc.indices_nonzero(pc.invert(ascii_))
        plain = pc.replace_substring_regex(pc.utf8_normalize(texts.take(at), "NFKD"), _INVISIBLE, "")
        texts = pc.replace_with_mask(texts, pc.invert(ascii_), plain)
    return texts


def _lines(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Row, text and key of every line that is not blank. The key hashes the line in lower case
    without surrounding blanks, a run of digits being one sign; it is never 0."""
    parts = pc.split_pattern_regex(texts, r"[\n\r]+")
    row = pc.list_parent_indices(parts).to_numpy(zero_copy_only=False)
    flat = pc.utf8_trim_whitespace(pc.list_flatten(parts))
    full = pc.not_equal(pc.utf8_length(flat), 0)
    row, flat = row[full.to_numpy(zero_copy_only=False)], flat.filter(full)
    norm = pc.replace_substring_regex(pc.utf8_lower(flat), r"\d+", "#").dictionary_encode()
    if isinstance(norm, pa.ChunkedArray):
        norm = norm.combine_chunks()
    own = np.fromiter((xxhash.xxh3_64_intdigest(s) >> 1 or 1 for s in norm.dictionary.to_pylist()), np.int64, len(norm.dictionary))
    return row, flat, own[norm.indices.to_numpy(zero_copy_only=False)] if len(flat) else np.zeros(0, np.int64)


_SLICE = 2048


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, text) to (host, h, n): documents of the batch with each line; key 0 counts all of them."""
    for whole in batches:
        for at in range(0, whole.num_rows, _SLICE):
            b = whole.slice(at, _SLICE)
            host = pc.dictionary_encode(b.column(0))
            code = host.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            row, _, key = _lines(b.column(1))
            pairs = np.unique(np.stack([row.astype(np.int64), key]), axis=1) if len(row) else np.zeros((2, 0), np.int64)
            both = np.concatenate([np.stack([code[pairs[0]], pairs[1]]), np.stack([code, np.zeros(len(code), np.int64)])], axis=1)
            seen, n = np.unique(both, axis=1, return_counts=True)
            yield pa.RecordBatch.from_arrays([host.dictionary.take(pa.array(seen[0])), pa.array(seen[1]), pa.array(n.astype(np.int64))], names=["host", "h", "n"])


def _hints(folded: pa.Array) -> pa.Array:
    return pc.or_(pc.match_substring_regex(folded, _SLOT_HINT), pc.match_substring_regex(pc.utf8_lower(folded), _MESSAGE_HINT + "|" + _FILLER_HINT))


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(ident, host, text) to (rid, ident, host, p, h, seg, hint): the folded sentences, with the
    number and key of their line, of every text that a first look cannot clear; ``hint``: the
    sentence itself needs a second look. RE2 reads a text once whatever the number of patterns."""
    task, seen = TaskContext.get(), 0
    base = (task.partitionId() if task else 0) << 33
    for whole in batches:
        for at in range(0, whole.num_rows, _SLICE):
            b = whole.slice(at, _SLICE)
            keep = b.filter(_hints(_folded(b.column(2))))
            row, line, key = _lines(keep.column(2))
            if len(row):
                plain = pc.replace_substring_regex(_folded(line), r"\s+", " ")
                parts = pc.split_pattern(pc.replace_substring_regex(plain, r"([.!?]) +", "\\1\n"), "\n")
                p = pc.list_parent_indices(parts).to_numpy(zero_copy_only=False)
                seg = pc.utf8_trim_whitespace(pc.list_flatten(parts))
                idx = pa.array(row[p])
                yield pa.RecordBatch.from_arrays([pa.array(base + seen + row[p].astype(np.int64)), keep.column(0).take(idx), keep.column(1).take(idx), pa.array(p.astype(np.int64)), pa.array(key[p]), seg, _hints(seg)], names=["rid", "ident", "host", "p", "h", "seg", "hint"])
            seen += keep.num_rows


def _unquoted(segment: Column) -> Column:
    """Without what is quoted: double quotes, inline code, escaped slots."""
    s = F.regexp_replace(segment, r"`[rR] (\w+)`", "@@r $1@@")
    s = F.regexp_replace(s, r"`[^`]*`", " ")
    return F.regexp_replace(s, r"\"[^\"]*\"|“[^”]*”|„[^“”]*[“”]|\\\S+", " ")


def _in(of: frozenset) -> str:
    return ", ".join("'" + x.replace("'", "\\'") + "'" for x in sorted(of))


def _has(words: str, of: frozenset) -> Column:
    return F.expr(f"exists({words}, x -> x in ({_in(of)}))")


def _count(words: str, of: frozenset) -> Column:
    return F.expr(f"size(filter({words}, x -> x in ({_in(of)})))")


def evidence(segments: DataFrame) -> DataFrame:
    """Add slot, error, notice, filler (boolean), message (the sentence is made of the words of
    messages) and words (its number of words) to sentences ``seg``.

    An error or a notice is a sentence that combines a thing and a failure, or scripts and a
    demand, and of whose words no more than FOREIGN are foreign to messages: a sentence that
    reports such a message has other things to tell. Filler is a sentence of a passage's
    Latin, of one repeated word or letter, of keyboard runs, or one that says text is to come.
    """
    s = segments.withColumn("raw", F.trim(_unquoted(F.col("seg"))))
    s = s.withColumns({"low": F.lower("raw"), "full": F.lower(F.trim("seg"))})
    tok = F.filter(F.split("low", r"[^\p{L}\p{N}']+"), lambda x: (F.length(x) > 0) & ~x.rlike(r"^['\d]+$"))
    s = s.withColumns({"w": F.transform(tok, lambda x: F.regexp_replace(x, r"^(?:n'|l'|d'|s'|qu'|')+|'(?:ll|re|ve|s|d|m)?$", "")), "neg": F.col("low").rlike(r"\bn'|n't\b")})
    s = s.withColumns({"n": F.size("w"), "known": _count("w", LEXICON), "own": F.expr(f"filter(w, x -> x not in ({_in(FUNCTION)}))"), "status": F.col("low").rlike(r"\b[45]\d\d\b")})
    w, n = F.col("w"), F.col("n")
    made = (n > 0) & (n - F.col("known") <= F.greatest(F.lit(1), F.floor(n * FOREIGN)))
    negated = (_has("w", NEGATION) | F.col("neg")) & _has("w", STATE)
    failed = _has("w", FAILURE) | negated | F.col("low").rlike(
        r"\btry again\b|\b(took|taking) too long\b|\btoo many\b|\btimed out\b|\b(limit|quota)\b.*\breached\b|\breached\b.*\b(limit|quota)\b|\bright back\b|\bbad (request|gateway)\b"
        r"|^(sign|log) (back )?in (again )?to\b|versuchen sie es (spater|erneut)|melden sie sich (erneut|wieder)? ?an|reessayer|intentelo (de nuevo|mas tarde)|inicie sesion"
    )
    bare = F.col("status") | (n <= 4) | _has("w", THING) | F.col("low").rlike(r"\b(session|sitzung|sesion|error|fehler|erreur|permission|oops|whoops|maintenance|again|requests?|wrong|limit|quota|later|back|in again|allowed|permitted|authori[sz]ed|erneut|reessayer|intentelo)\b")
    # a bare word of failure inside a sentence of a few words is a remark, not a message
    error = made & failed & bare & (F.col("known") >= 2) & ~F.col("low").rlike(r"^(no idea|no (difference|longer drops))\b")
    trace = F.col("low").rlike(_any(TRACES)) | F.col("full").rlike(r"\"error\"\s*:|<error\b")
    notice = (made & _has("w", SCRIPT) & (_has("w", DEMAND) | F.col("neg") | _has("w", NEGATION) | _has("w", FAILURE)) & (F.col("known") >= 3)) | F.col("low").rlike(r"^loading\s*(\.|…|$)")
    latin = F.expr(f"size(filter(w, x -> substring(x, 1, 4) in ({_in(frozenset(LATIN))})))")
    spoken = _has("w", SPOKEN)
    letters = F.regexp_replace("low", r"[^a-z]+", "")
    filler = (
        ((n >= 4) & ~spoken & (latin >= 2) & (latin >= n * 0.4))
        | F.col("low").rlike(r"\blorem ipsum\b")
        | ((F.size("own") >= 6) & (F.size(F.array_distinct("own")) * 3 <= F.size("own")))
        | ((n >= 4) & (F.length(letters) >= 8) & (F.length(F.regexp_replace(letters, r"x+", "")) == 0))
        | ((n >= 3) & (F.size(F.filter(w, lambda x: (F.length(x) >= 4) & (F.instr(F.lit(KEYBOARD), x) > 0))) >= n * 0.6))
        | ((n - _count("w", FILLER_LEXICON) <= F.floor(n * FOREIGN)) & ((_has("w", PAPER) & _has("w", TO_COME)) | _has("w", ALWAYS_FILLER) | (_has("w", TO_COME) & (n <= 2) & F.col("low").rlike(r"\b(ersetzen|remplacez|reemplace|sustituya)\b"))))
    )
    slots = _any(SLOTS)
    slot = F.col("raw").rlike(slots) & ~F.regexp_replace(F.trim("seg"), slots, " ").rlike("(?i)" + MENTION)
    mute = (n >= 3) & ~spoken & F.col("low").rlike(r"\w+\W+\w+\W+\w+")
    return s.select(
        *segments.columns, slot.alias("slot"), (error | trace).alias("error"), notice.alias("notice"), filler.alias("filler"), mute.alias("mute"),
        (made | F.col("full").rlike(_any(BESIDE)) | trace).alias("message"), F.size(F.filter(F.split("full", r"[^\p{L}\p{N}']+"), lambda x: x != "")).alias("words"),
    )


def residue(documents: DataFrame, ident: str = "doc_id", text: str = "text", host: str = "source", few_words: int = FEW_WORDS) -> DataFrame:
    """(ident, slot, error, notice, filler, residual_words): documents that are residue, one row
    per input row that is. ``slot``: an unfilled slot stands where a value should. Else the text's
    residual holds a filler, an error message or a notice and at most ``few_words`` other words.

    Null, empty and blank texts are never residue. Repeated rows come out repeated; other columns
    are ignored; a null host is a host of its own; an empty table gives no rows. Hosts compare
    without case and surrounding white space.

    Normalised lines of any length (lower case, digits as one sign) are counted by host over all
    documents, with partial sums before the shuffle. Recurrent lines are subtracted first; all
    evidence, slots included, is taken from what remains. A recurrent line that holds evidence
    itself is kept if most documents with it have nothing else of their own: it is the page then,
    not boilerplate around one. Quoted strings, inline code and sentences about placeholders are
    no evidence. Texts of any length stay whole.
    """
    need(documents, ident, text, host)
    kind = dict(documents.dtypes)[ident]
    src = documents.select(F.col(ident).alias("ident"), F.coalesce(source_key(host), F.lit("")).alias("host"), F.col(text).cast("string").alias("text")).where(F.length(F.trim("text")) > 0)
    counted = src.select("host", "text").mapInArrow(_counter, "host string, h long, n long").groupBy("host", "h").agg(F.sum("n").alias("n"))
    counted = cut(counted.where((F.col("n") >= MIN_DOCS) | (F.col("h") == 0)))
    sizes = counted.where("h = 0").select("host", F.col("n").alias("docs"))
    counted = counted.where("h <> 0")
    own = counted.join(bounded(sizes), "host").where(F.col("n") >= F.col("docs") * MIN_SHARE).select("host", "h")
    every = sizes.agg(F.sum("docs").alias("docs"))
    anywhere = counted.groupBy("h").agg(F.sum("n").alias("n")).join(F.broadcast(every)).where(F.col("n") >= F.col("docs") * MIN_SHARE).select("h")
    cand = cut(src.mapInArrow(_candidates, f"rid long, ident {kind}, host string, p long, h long, seg string, hint boolean").where("seg <> ''"))
    cand = cand.join(bounded(own.withColumn("own", F.lit(True))), ["host", "h"], "left").join(bounded(anywhere.withColumn("all", F.lit(True))), "h", "left")
    cand = cand.withColumn("again", F.coalesce("own", "all", F.lit(False))).drop("own", "all")
    flags = ["slot", "error", "notice", "filler"]
    signs = cut(evidence(cand.where("hint")).where(" or ".join(flags)))
    # the words beside the evidence of a text, by sentence; only texts with evidence are read again
    rest = evidence(cand.where("not again").join(signs.select("rid").distinct(), "rid", "left_semi"))
    words = F.when(F.col("message") | F.col("error") | F.col("notice") | F.col("filler"), 0)
    beside = rest.groupBy("rid").agg(F.sum(words.otherwise(F.col("words"))).alias("all_words"), F.sum(words.when(F.col("mute"), 0).otherwise(F.col("words"))).alias("spoken"))
    # a recurrent message is the page itself where its documents have no words of their own
    again = signs.where("again and (error or notice or filler)")
    pages = again.select("rid", "host", "h").distinct().join(beside, "rid", "left").groupBy("host", "h").agg(F.avg((F.coalesce("all_words", F.lit(0)) < OWN_WORDS).cast("double")).alias("alone")).where(F.col("alone") >= ALONE_SHARE)
    back = again.join(bounded(pages.select("host", "h")), ["host", "h"], "left_semi").withColumn("slot", F.lit(False))
    doc = signs.where("not again").unionByName(back).groupBy("rid").agg(F.first("ident").alias("ident"), *[F.max(c).alias(c) for c in flags]).join(beside, "rid", "left")
    doc = doc.withColumn("residual_words", F.coalesce(F.when(F.col("filler"), F.col("spoken")).otherwise(F.col("all_words")), F.lit(0)))
    page = (F.col("error") | F.col("notice") | F.col("filler")) & (F.col("residual_words") <= few_words)
    return doc.where(F.col("slot") | page).select(F.col("ident").alias(ident), *flags, "residual_words")


def without_residue(documents: DataFrame, ident: str = "doc_id", **how) -> DataFrame:
    """The documents that are no residue."""
    return documents.join(residue(documents, ident, **how).select(ident).distinct(), ident, "left_anti")
