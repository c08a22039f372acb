"""Wordings, in folded text, that the labels of quotation checks rest on. They must be these for right results."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from itertools import accumulate

#: Floors of a quotation, the widest gap between its fragments, and windows in characters.
LEAST_WORDS, LEAST_CHARS, WIDEST_GAP = 4, 25, 1500
CLOSING_WINDOW, STATE = 450, "estado de sergipe"
PARENTHESES, SENTENCE_REST, OPENING_REACH, CHAIN, LONG_CHAIN, SHORT_REACH = 700, 300, 9000, 1200, 6000, 300
WIDEST_QUOTE, THESIS_BEFORE = 6000, 80
CLAIM_BEFORE, SUBJECT_BEFORE, HEAD_SHARE, SUBJECT_AFTER = 600, 200, 0.4, 40
NEGATION_BEFORE, NEGATION_REACH = 80, 3
OBITER_BEFORE, OBITER_LONGEST, RESULT_AFTER = 400, 600, 300

A = re.ASCII
FRAGMENTS = re.compile(r"\[\s*\.\.\.\s*\]|\(\s*\.\.\.\s*\)")
#: What may begin a pattern, and what it keeps from standing before its first letter.
EDGES = {r"\b": r"\w", "(?<![a-z0-9])": "[a-z0-9]"}


TOKENS = re.compile(r"\\.|\[\^?\]?(?:\\.|[^\]\\])*\]|.", re.S)


def parted(pattern: str) -> list[str]:
    """A pattern's alternatives."""
    depth, out = 0, [""]
    for token in TOKENS.findall(pattern):
        depth += (token == "(") - (token == ")")
        if token == "|" and not depth:
            out.append("")
        else:
            out[-1] += token
    return out


def edge_of(form: str) -> str:
    return next((e for e in EDGES if form.startswith(e)), "")


def unfolded(form: str) -> list[str]:
    """A form for each alternative of the group that it begins with."""
    group = re.match(r"\((?:\?:|(?!\?))", form)
    if not group:
        return [form]
    tokens = TOKENS.findall(form)
    end = [*accumulate((t == "(") - (t == ")") for t in tokens)].index(0)
    inner, after = "".join(tokens[:end])[group.end() :], "".join(tokens[end + 1 :])
    return [form] if after.startswith(("?", "*", "+", "{")) else [f for part in parted(inner) for f in unfolded(part + after)]


def led(pattern: str) -> str:
    """The same pattern with what its alternatives begin with, a letter or a parenthesis, first, once each, and what may not stand before
    a letter looked at after it: a search goes from one such sign to the next rather than try every place with every alternative.
    Alternatives of one sign keep their order; those of two never match at one place."""
    rests: dict[tuple[str, str], list[str]] = {}
    for form in parted(pattern):
        edge = edge_of(form)
        for f in unfolded(form.removeprefix(edge)):
            sign = re.match(r"[A-Za-z](?![?*+{])" if edge else r"\\\((?![?*+{])", f)
            if not sign:
                return pattern
            rests.setdefault((sign[0], edge), []).append(f[sign.end() :])
    return "|".join(sign + (f"(?<!{EDGES[edge]}{sign})" if edge else "") + f"(?:{'|'.join(each)})" for (sign, edge), each in rests.items())


def searched(pattern: str, flags: int = 0) -> re.Pattern:
    return re.compile(led(pattern), flags)


class Sought:
    """A pattern for whole texts. Each alternative begins with some letters: these are looked for, and the pattern is tried where they stand."""

    def __init__(self, pattern: str, flags: int = 0) -> None:
        self.pattern = searched(pattern, flags)
        self.heads = sorted({head(f) for form in parted(pattern) for f in unfolded(form.removeprefix(edge_of(form)))})
        if not all(self.heads):
            raise ValueError(f"an alternative begins with no letter: {pattern}")

    def finditer(self, text: str, start: int = 0, end: int = sys.maxsize) -> Iterator[re.Match]:
        for at in sorted({at for h in self.heads for at in occurrences(text, h, start, end)}):
            if at >= start and (m := self.pattern.match(text, at, end)):
                start = m.end()
                yield m

    def search(self, text: str, start: int = 0) -> re.Match | None:
        return next(self.finditer(text, start), None)


def head(form: str) -> str:
    """The characters that every match of a form begins with."""
    out = []
    for token in TOKENS.findall(form):
        if token in ("?", "*", "{"):
            return "".join(out[:-1])
        if len(token) == 1 and token in ".^$+[]()|" or len(token) > 1 and (token[0] == "[" or token[1].isalnum()):
            break
        out.append(token[-1])
    return "".join(out)


def occurrences(text: str, part: str, start: int, end: int) -> Iterator[int]:
    at = text.find(part, start, end)
    while at >= 0:
        yield at
        at = text.find(part, at + 1, end)


#: What parts words of a-z and 0-9 in folded text as blanks.
APART = {point: " " for point in range(128) if not re.match("[a-z0-9]", chr(point))}
COURT = r"(?:tj-?[a-z]{2}|stj|stf|trf-?\d|tst|trt-?\d+|tnu)"
#: What attributes a transcription to another court.
ATTRIBUTION = Sought(
    r"\(" + COURT + r"\b"
    r"|\((?:resp|aresp|agint|agrg|edcl|eresp|rms|adi|adpf|apelacao(?: civel)?|agravo de instrumento)\b[^()]{0,220}\brel(?:ator[a]?|\.)?\s*(?:p/|para|min|des|juiz|dr)"
    r"|\b" + COURT + r"\s*[-,–]\s*(?:resp|aresp|agint|agrg|edcl|re|are|hc|rhc|apelacao|ac|ai)\b[^.\n]{0,200}\brel"
)
#: What opens a transcription.
OPENING = Sought(
    r"\bementa\s*:|\bementa\b(?=\s*[-.]?\s*[a-z])|\bacordao\s*:|\bprecedentes?\s*:|\btranscrevo\b|\bin verbis\b|\bnos seguintes termos\s*:|"
    r"\bassim (?:decidiu|se manifestou|ementado)\b|\bsumula\s+(?:vinculante\s+)?n?\s*\d+\s*[:-]"
)
#: The rapporteur's own voice, between an opening and an attribution.
OWN_VOICE = Sought(
    r"\b(nesse sentido|neste sentido|com efeito|no caso dos autos|no caso em tela|entendo|ante o exposto|diante do exposto|pelo exposto|e como voto|voto por|voto pelo|passo a|compulsando)\b"
)
LIKE_ABSTRACT = Sought(
    r"\brecurso\s+(?:\w+\s+){0,3}(?:conhecido|provido|desprovido|improvido|nao provido)\b|\btese de julgamento\b|\bcaso em exame\b|\bquestao em discussao\b|"
    r"\bdispositivos? relevantes?\b|\bsentenca (?:mantida|reformada)\b|\bapelacao\s+(?:civel\s+)?(?:conhecida|provida|desprovida)\b"
)
DIVERGENCE = Sought(
    r"\b(?:peco|pedi[dn]o\s+de?|com a devida|data)\s+venia\b[^.]{0,120}\b(?:diverg|discord)|\bdivirjo\b|\bvoto\s+(?:vencido|divergente|vista)\b|\bouso\s+divergir\b|\bvoto[- ]vista\b"
)
#: Verbs that report what someone claims.
REPORT = searched(
    r"(?<![a-z0-9])(?:sustent(?:a|am|ou|aram|ando)|alega(?:m|ram|ndo)?|alegou|aduz(?:em|iu|indo)?|defende(?:m|u|ram|ndo)?|afirma(?:m|ram|ndo)?|afirmou"
    r"|argument(?:a|am|ou|ando)|requer(?:em|eu|eram|endo)?|pleite(?:ia|iam|ou|aram|ando)|pugn(?:a|am|ou|ando)|invoc(?:a|am|ou|ando)"
    r"|insist(?:e|em|iu|indo)|impugn(?:a|am|ou|ando)|assever(?:a|am|ou|ando)|ressalt(?:a|am|ou)|enfatiz(?:a|am|ou)|reiter(?:a|am|ou)"
    r"|postul(?:a|am|ou)|narr(?:a|am|ou)|inform(?:a|am|ou)|disse|suscit(?:a|am|ou)|apont(?:a|am|ou)"
    r"|alegue|alegu?em|sustente|sustentem|defenda|defendam|afirme|argumente|pretend(?:a|e|em|eu)|pretendam|ped(?:e|em|iu|iram|indo)|propugn(?:a|am|ou|ando)"
    r"|acrescent(?:a|am|ou|ando)|destac(?:a|am|ou|ando)|pondera(?:m|ram|ndo)?|ponderou|anota(?:m|ram|ndo)?|anotou|diz)(?![a-z0-9])",
    A,
)
PARTY = searched(
    r"(?<![a-z0-9])(?:apelantes?|apelad[oa]s?|agravantes?|agravad[oa]s?|recorrentes?|recorrid[oa]s?|embargantes?|embargad[oa]s?|autor(?:a|es|as)?|reus?|re|requerentes?|requerid[oa]s?"
    r"|impetrantes?|impetrad[oa]s?|exequentes?|executad[oa]s?|partes?|banco|instituicao financeira|estado|municipio|uniao|ministerio publico|parquet|defensoria|procuradoria|arguentes?"
    r"|arguid[oa]s?|reclamantes?|reclamad[oa]s?|seguradora|fundo|cessionari[oa]|devedor[a]?|credor[a]?|locatari[oa]|locador[a]?|consumidor[a]?"
    r"|obreir[oa]s?|empregador(?:a|es|as)?|trabalhador(?:a|es|as)?|sindicato|litisconsortes?|demandad[oa]s?|demandantes?|ente publico|suscitantes?|suscitad[oa]s?|paciente|defesa|fazenda)(?![a-z0-9])",
    A,
)
IN_PLEADING = searched(r"(?<![a-z0-9])(?:(?:em|nas|suas) (?:suas )?razoes|contrarrazoes)(?![a-z0-9])", A)
#: The court speaking, between a reporting verb and the quotation.
COURT_SPEAKS = searched(
    r"\b(?:nesse sentido|neste sentido|com efeito|no caso dos autos|no caso em tela|no caso concreto|in casu|na hipotese dos autos|na especie|entendo|ante o exposto|diante do exposto|pelo exposto"
    r"|isso posto|e como voto|e o voto|voto por|voto pelo|passo a|compulsando|assim sendo|dessa forma|desta forma|rejeito|nao vejo|submeto aos pares|como se sabe|como foi narrado|nesse contexto)\b"
    r"|\b(?:i|v|x)[ivx]{0,3}\s*[-.)]\s*d[aeo]s?\s+(?:merito|preliminar|recurso|apelacao|dano|pedido)",
    A,
)
COURT_FINDS = searched(
    r"(?<![a-z0-9])(?:contudo|todavia|entretanto|no entanto|ocorre que|porem|de fato|com efeito|sem razao|nao assiste|nao merece|nao prospera|improcede|conheco|constato|constatei|verifico|verifiquei"
    r"|observo|observei|analisei|tenho que|consigno|cumpre|importante destacar|e importante|e certo|e sabido|como e sabido|ora,|logo,|assim,|portanto|dessa forma|neste caso|nesse caso|nesse cenario"
    r"|nessa hipotese|no caso|a meu ver|na verdade|diante disso|nessa linha|revela|homologo|condeno|julgo|determino|arbitro|fixo|defiro|indefiro|nego|dou provimento|acolho|rejeito|declaro|reconheco"
    r"|entendo|concluo|decido|passo a"
    r"|tem-se|tem se|infere-se|conclui-se|depreende-se|extrai-se|verifica- ?se|constata- ?se|nota-se|observa- ?se|percebe-se|denota-se|ve-se|evidencia-se|trata-se"
    r"|nao ha duvidas?|nao resta duvida|nao restam duvidas|compete ao|compete a|cabe ao|cabia ao|incumbe|incumbia|com razao|razao assiste|assiste razao)(?![a-z0-9])",
    A,
)
ABBREVIATION = re.compile(r"(?:^|[^a-z0-9])(?:art|arts|n|no|nos|fl|fls|id|ids|des|desa|dr|dra|sr|sra|min|rel|inc|p|pp|pag|proc|cf|num|ex|exmo|exma|res|sum|ed|v|vol|cap|al|rr|c/c|ss)$", A)
SENTENCE_END = re.compile(r"[.;!?][\"”’»)\]]?\s+(?=[\"“‘«(\[]?[A-ZÀ-Ý0-9])", A)
ADVERSATIVE = searched(r"(?<![a-z0-9])(?:contudo|todavia|entretanto|no entanto|porem|mas(?! tambem))(?![a-z0-9])", A)
NOT_BEFORE = searched(r"(?<![a-z0-9])nao(?![a-z0-9])[^.;]{0,70}$", A)
CONCESSIVE = searched(r"(?<![a-z0-9])(?:embora|conquanto|ainda que|apesar de|em que pese|nao obstante|a despeito de|malgrado|se bem que)(?![a-z0-9])[^,.;]{0,90}$", A)
ACCORDING_TO = searched(
    r"(?<![a-z0-9])(?:segundo|conforme|de acordo com|na visao d[eoa]|para)\s+(?:[oa]s?\s+)?(?:parte\s+)?(?:apelantes?|apelad[oa]s?|agravantes?|agravad[oa]s?|recorrentes?|recorrid[oa]s?|embargantes?"
    r"|embargad[oa]s?|autor(?:a|es|as)?|reus?|requerentes?|requerid[oa]s?|reclamantes?|reclamad[oa]s?|banco|inicial|contestacao)(?![a-z0-9])",
    A,
)
VERB_DENIED = re.compile(r"(?:^|[^a-z0-9])(?:nao|nem|jamais|nunca)\s+(?:se\s+)?$", A)
VERB_OPENS = re.compile(r"\s*(?:[a-z]+(?: [a-z]+){0,4},\s+){0,2}(?:[a-z]+\s+){0,2}", A)
CONTRARY = re.compile(r"(?:ao contrario|diferentemente|diversamente|contrariamente)\s+(?:do|ao)\s+que\s+(?:[a-z]+\s+){0,2}$", A)
SUBJECT_ENDS = re.compile(r"[,.;]| que ", A)
NEGATION = searched(
    r"(?<![a-z0-9])(?:nao|jamais|nunca|nem|descabe|descabid[oa]s?|incabive(?:l|is)|afasta-se|afasto|afastad[oa]s?|rejeita-se|rejeito|rejeitad[oa]s?|nego|negou|negar|nega-se|negam|improcede"
    r"|julg(?:ou|o|ar|aram|ada|ado|ados|adas)\s+improcedentes?|inexist(?:e|em|ir|iu|indo)|carece|carecem|impossibilidade de|sem razao|sem razoes)(?![a-z0-9])",
    A,
)
NO_NEGATION = re.compile(
    r"\s*(?:obstante|so\b|apenas|somente|se\s+confunde|fosse\b|(?:havendo|ha|houve|resta|restam|restando|pairam?)\s+(?:qualquer\s+|mais\s+)?duvidas?"
    r"|(?:e|era|foi|sao|seria)\s+(?:outr[oa]s?|diferente|divers[oa]s?)\b|se\s+(?:desconhece|ignora|olvida|nega|discute|questiona)\b"
    r"|(?:se\s+)?pode\s+(?:deixar|olvidar|ignorar|negar)\b|deixa\s+de\b|ha\s+como\s+negar|ha\s+negar)",
    A,
)
#: A preposition, or a participle without its auxiliary, takes a `nao` for itself.
DENIED_BY_ITSELF = re.compile(
    r"\s*(?:sobre|pel[oa]s?|para|por|com|contra|ante|perante|apenas|so|somente|mais|menos)\b"
    r"|(?!\s*(?:tenha|tem|ha|havia|foi|for|seja|sido|esta|estava)\b)\s*(?:\w+mente\s+)?[a-z]+(?:ad|id)[oa]s?\b",
    A,
)
#: Up to six words of one clause, with a comma only where all of it has fifteen characters or fewer.
BRIDGE = re.compile(r"(?=\s*(?:\S+(?:\s+|\Z)){0,6}\Z)(?:[^.;:,]*|(?= *.{0,15} *\Z)[^.;:]*)", re.S)
#: One word at most, or up to five of which the first says that something is or was there.
CLOSE_BRIDGE = re.compile(r"\s*(?:\S+\s*)?|(?=\s*(?:\S+(?:\s+|\Z)){0,5}\Z)\s*(?:ha|houve|havia|existe|existem|existia)(?![a-z0-9]).*", re.S)
CONJUNCTION = re.compile(r"\s*[eE][\s,]")
CLAUSE_END = re.compile(
    r"[.;:]|,\s*(?:mas|e|ou|que|o que|de forma|de modo|sendo|alem|conforme|porque|pois|porquanto|embora|ainda|razao pela|motivo pelo|[a-z]+ndo)(?![a-z0-9])|\smas\s", A
)
OBITER_MARK = searched(
    r"(?<![a-z0-9])(?:ainda que assim nao fosse|se assim nao fosse|(?:ainda|mesmo) que (?:se )?(?:admitisse(?:mos)?|superad[ao]s?|ultrapassad[ao]s?|afastad[ao]s?|entendesse(?:mos)?|considerasse(?:mos)?"
    r"|fosse|houvesse|pudesse)|a titulo de (?:argumentacao|reforco|ilustracao|obiter dictum)|(?:apenas|somente|so) para argumentar|ad argumentandum(?: tantum)?|por amor ao debate|obiter dictum"
    r"|caso se entendesse|registre-se,? (?:por oportuno|de passagem)|a titulo de registro|apenas (?:para|a titulo de) registro)(?![a-z0-9])",
    A,
)
OWN_THESIS = searched(r"\btese\s+(?:juridica\s+)?(?:fixada|firmada|proposta)\b|\bfixando a seguinte tese\b|\bseguinte tese\b", A)
DISPOSITIVE = Sought(
    r"(?<![a-z0-9])(?:ante o exposto|diante do exposto|pelo exposto|em face do exposto|por todo o exposto|posto isso|posto isto|isso posto|isto posto|por tais razoes|por essas razoes|por todas essas razoes"
    r"|com essas consideracoes|com tais consideracoes|ex positis|forte nessas razoes)(?![a-z0-9])",
    A,
)
RESULT = searched(
    r"(?<![a-z0-9])(?:nego|dou|conheco|nao conheco|julgo|rejeito|acolho|mantenho|reformo|provimento|provido|desprovido|improcedente|procedente|prejudicado|homologo|declaro|defiro|indefiro|concedo|denego"
    r"|extingo|anulo|casso|confirmo|voto (?:pelo|por|no sentido))(?![a-z0-9])",
    A,
)
CLOSINGS = (
    Sought(r"(?<![a-z0-9])acordao[ \t\n\r\f\v]+(?:vistos|acordam)(?![a-z0-9])"),
    Sought(r"(?<![a-z0-9])acordam[ \t\n\r\f\v]+(?:os|as)[ \t\n\r\f\v]+(?:membros|desembargador|integrantes|juiz|juizes|magistrad)"),
)
ACORDAM_NORM = Sought(r"\bacordam\b")
ACORDAM = Sought(r"(?<![a-z0-9])acordam(?![a-z0-9])")
SECTION_NAME = re.compile(
    r"(?<![a-z0-9])(?:(i{1,3}|iv|v)[ \t\n\r\f\v]*[.)-]?[ \t\n\r\f\v]*)?(caso em exame|quest(?:ao|oes) em discussao|razoes de decidir|dispositivos? e teses?|dispositivo)(?![a-z0-9])", A
)
#: Section names that are written in more than one way.
SECTION_ALIASES = {"questoes em discussao": "questao em discussao", "dispositivos e teses": "dispositivo e tese", "dispositivo e teses": "dispositivo e tese", "dispositivos e tese": "dispositivo e tese"}
ABSTRACT_TAIL = re.compile(r"\b(?:Dispositivos? relevantes? citados?|Jurisprud[êe]ncia relevante citada|Legisla[çc][ãa]o relevante citada|Resumo em linguagem simples|RESUMO[ \t]*:)", A)
#: Headings in the raw text.
ABSTRACT, REPORT_HEAD, VOTE_HEAD = re.compile(r"[ \t\n\r\f\v]*EMENTA\b", A), Sought(r"\bRELAT[ÓO]RIO\b", A), Sought(r"\bVOTO\b", A)
#: Quotation marks: the kind that they pair in, and whether they open (1), close (-1) or go by what stands beside them (0).
QUOTATION_MARKS = {"“": ("double", 1), "”": ("double", -1), '"': ("double", 0), "‘": ("single", 1), "’": ("single", -1), "«": ("angle", 1), "»": ("angle", -1)}
BEFORE_OPENING, AFTER_CLOSING = " \t\n\r\xa0([{—–-:/", " \t\n\r\xa0.,;:)]}!?—–-/"
