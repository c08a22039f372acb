"""A small invented corpus of decisions, the one source of the Spark frames and of the VALUES in their SQL.

No real decision, person or case is in it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: decision, process, issue, body, class, abstract
DECISIONS = (
    ("20261001", "202600000101", 1, "1ª Câmara Cível", "Apelação", "EMENTA INVENTADA. PLANO DE SAÚDE. I. CASO EM EXAME 1. Apelação contra sentença. II. QUESTÃO EM DISCUSSÃO 2. Saber se cabe dano moral. III. RAZÕES DE DECIDIR 3. A negativa foi abusiva. IV. DISPOSITIVO E TESE 4. Recurso desprovido. Tese de julgamento: a negativa gera dano. Jurisprudência relevante citada: TJSE, processo 202500000777; STJ, Súmula 297."),
    ("20261002", "202600000102", 1, "1ª Câmara Cível", "Apelação", "DIREITO DO CONSUMIDOR. Recurso conhecido e provido. Aplica-se a Súmula 297/STJ e o Tema 1.061."),
    ("20261003", "202600000101", 2, "2ª Câmara Cível", "Embargos de Declaração", "EMBARGOS. Recurso parcialmente provido. Súmula Vinculante 47. IRDR nº 15."),
    ("20261004", "202600000104", 2, "Câmara Criminal", "Habeas Corpus", "HABEAS CORPUS. Recurso não conhecido. Tema 506."),
    ("9261005", "202600000105", 2, "Câmara Criminal", "Apelação", "PENAL. Recurso desprovido; recurso do autor provido em parte."),
    ("20261006", "202600000106", 4, "2ª Câmara Cível", "Agravo de Instrumento", "AGRAVO. Negou provimento ao agravo. Súmula nº 7 do STJ. IAC 3."),
    ("20261007", "202600000107", 4, "2ª Câmara Cível", "Agravo de Instrumento", "AGRAVO. Deram provimento ao recurso. Tema repetitivo 1061."),
    ("20261008", "202600000107", 4, "2ª Câmara Cível", "Agravo Interno", "AGRAVO INTERNO. Sem resultado claro. TJSE: Súmula 12."),
)
#: issue, label, date
ISSUES = ((1, "101", "2026-01-31"), (2, "102", "2026-02-28"), (3, "103", None), (4, "104", "2026-04-30"), (5, "105", None))
#: issue, code, items
SECTIONS = tuple((i, c, 2) for i, codes in ((1, (5, 6, 7, 8, 10)), (2, (5, 6)), (4, (5, 6, 7))) for c in codes)

CELL = (
    '<tr><td><font style="font-size: 10pt">{cls}</font></td></tr><tr><td><font>EMENTA: {abstract}</font><br>PROCESSO: <a href="relatorio.wsp?tmp.numprocesso={process}&amp;tmp.numacordao={decision}">'
    "{process}</a><br><div>AC Nº 1{decision}/2026</div><div>RELATOR: DES. FULANO DE TAL</div></td></tr>"
)


def section_pages() -> list[tuple[int, int, int, str]]:
    """(issue, code, page, html): a section over two pages; the second goes on in the class of the first, and repeats it in a comment."""
    a, b, c = DECISIONS[:3]
    cell = lambda d, head=True: (CELL if head else CELL.split("</tr>", 1)[1]).format(decision=d[0], process=d[1], cls=d[4], abstract=d[5])
    return [(1, 5, 1, f"<table>{cell(a)}{cell(b)}</table><!--<table>{cell(a)}</table>-->"), (1, 5, 2, f"<table>{cell(c, False)}</table>")]


FULL_TEXT = (
    "<div>ACÓRDÃO: 20261001</div><div>RECURSO: Apelação Cível</div><div>PROCESSO: 202600000101</div><div>RELATOR: DES. FULANO DE TAL</div>"
    "<p>EMENTA</p><p>I. CASO EM EXAME 1. Apelação contra sentença que julgou procedente o pedido.</p><p>III. RAZÕES DE DECIDIR 3. A negativa de cobertura foi abusiva e gera dever de reparar.</p>"
    "<p>ACÓRDÃO</p><p>Vistos, acordam os integrantes do Grupo 2 da Primeira Câmara Cível do Tribunal de Justiça do Estado de Sergipe, por unanimidade, negar provimento.</p>"
    "<p>Aracaju/SE, 31 de Agosto de 2026.</p><p>RELATÓRIO</p><p>Sustenta a apelante que o contrato excluía expressamente o tratamento pedido pela autora.</p>"
    "<p>VOTO</p><p>A cláusula é clara quanto ao prazo de carência aplicável ao caso. Não há prova de que o beneficiário tenha sido informado do limite de cobertura.</p>"
    "<p>Como já se decidiu: “a operadora responde pelos danos causados ao consumidor em caso de recusa indevida”.</p>"
    "<p>Ainda que assim não fosse, o prazo contratual de carência já estava vencido na data do pedido.</p>"
    "<p>Precedentes: Apelação cível. Plano de saúde. Recusa injustificada de cobertura configura dano moral. (TJ-MG - AC 123, Rel. Des. Beltrano)</p>"
    "<p>Ante o exposto, nego provimento ao recurso e mantenho integralmente a sentença recorrida.</p>"
)
#: id, quotation
QUOTATIONS = (
    (1, "A cláusula é clara quanto ao prazo de carência aplicável ao caso"),
    (2, "o contrato excluía expressamente o tratamento pedido pela autora"),
    (3, "a operadora responde pelos danos causados ao consumidor"),
    (4, "o prazo contratual de carência já estava vencido"),
    (5, "Recusa injustificada de cobertura configura dano moral"),
    (6, "mantenho integralmente a sentença recorrida"),
    (7, "a cláusula é clara [...] limite de cobertura"),
    (8, "isto não está escrito em parte alguma da decisão"),
    (9, "curto demais"),
    (10, "prova de que o beneficiário tenha sido informado do limite de cobertura"),
)

SCHEMAS = {
    "decisions": "decision string, process string, issue int, body string, class string, abstract string",
    "issues": "issue int, label string, date string",
    "sections": "issue int, code int, items int",
}


def frame(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame(list({"decisions": DECISIONS, "issues": ISSUES, "sections": SECTIONS}[name]), SCHEMAS[name])


def values(name: str) -> str:
    """The same rows as a SQL common table of that name."""
    quote = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    rows = {"decisions": DECISIONS, "issues": ISSUES, "sections": SECTIONS}[name]
    columns = ", ".join(f'"{c.split()[0]}"' for c in SCHEMAS[name].split(", "))
    return f"{name}({columns}) AS (VALUES " + ", ".join("(" + ", ".join(map(quote, r)) + ")" for r in rows) + ")"
