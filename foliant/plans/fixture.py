"""A damaged book made from plain documents: each line gets a kind of damage by its number, each document a preface.

The text is the same in Spark and in DuckDB, so queries over it can be checked against SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Damage by line, and prefaces by document; valid in both dialects.
DAMAGE = r"""decor AS (SELECT doc_id, lang, line_no, CASE (doc_id*31+line_no*17)%32
 WHEN 0 THEN concat('## ',substr(line,1,40))
 WHEN 1 THEN concat('#### ',substr(line,1,30))
 WHEN 2 THEN concat('###### ',substr(line,1,30))
 WHEN 3 THEN concat('########  ',substr(line,1,30))
 WHEN 4 THEN concat('> ',line,' that',chr(10),'>',chr(10),'> ',lower(substr(line,1,60)))
 WHEN 5 THEN concat('> ',line)
 WHEN 6 THEN concat(chr(10),line)
 WHEN 7 THEN concat('   ',chr(10),cast(line_no%400 as string),chr(10),'   ',chr(10),line)
 WHEN 8 THEN concat(substr(line,1,60),'-',chr(10),lower(substr(line,61,60)))
 WHEN 9 THEN concat(substr(line,1,50),' of the',chr(10),chr(10),substr(line,51,400))
 WHEN 10 THEN concat('![fig](./images/media/image',cast(line_no as string),'.png)',chr(10),line,' <img src="x.png">')
 WHEN 11 THEN concat('| a | b |',chr(10),'|---|---|',chr(10),'| 1 | 2 |',chr(10),'| x | y | z |')
 WHEN 12 THEN concat(line,' †')
 WHEN 13 THEN concat('The humau aud wheu ueutral 2ud leeel of you. ',line)
 WHEN 14 THEN concat('Armor repair 125gp',chr(10),'per point restored',chr(10),'Shield, small',chr(10),'10gp 20gp')
 WHEN 15 THEN concat(', and ',lower(line))
 WHEN 16 THEN concat('```',chr(10),'code |x|',chr(10),'```')
 WHEN 17 THEN concat(line,'  ',line)
 WHEN 18 THEN concat(chr(10),chr(10),chr(10),line)
 WHEN 19 THEN concat('Enconnters wonld follow the Conncil , north ; ',line)
 WHEN 20 THEN concat('The',chr(10),line)
 WHEN 21 THEN '**Standard**: Alder, Birch, Cedar, Douglas, Elder, Fir, Gorse, Hazel, Ivy, Juniper'
 WHEN 22 THEN '**Common** (d20): 1 Alder, 2 Birch, 3 Cedar, 4 Douglas, 5 Elder, 6 Fir, 7 Gorse, 8 Hazel'
 WHEN 23 THEN concat('He carries swords, bows,',chr(10),'and spears',chr(10),'However ',lower(line))
 WHEN 24 THEN concat('<1> ',substr(line,1,30))
 WHEN 25 THEN concat('###### Part II',chr(10),'###### Population')
 WHEN 26 THEN concat(substr(line,1,40),' socially',chr(10),'conscious ',lower(substr(line,41,60)))
 WHEN 27 THEN concat(substr(line,1,60),' decided',chr(10),chr(10),'was better than ',lower(substr(line,61,60)))
 WHEN 28 THEN concat('Wait -- no --- yes.Then ',line)
 ELSE line END AS dl FROM base)"""
PREFACE = r"""concat(CASE doc_id%5
 WHEN 0 THEN concat('Table Of Contents',chr(10),'1.Townbridge   12',chr(10),'90:Gate 14',chr(10),'7',chr(10),'Loose entry',chr(10),'Castles Zagyg: Yggsburgh',chr(10))
 WHEN 1 THEN concat('## Table Of Contents',chr(10),'Gate .................... 12 Moat ................... 34',chr(10),'Tower ................... 56',chr(10),'The Table of Contents will likely change',chr(10),'# Part I: Start',chr(10))
 WHEN 2 THEN concat('[Alpha]()',chr(10),'[Beta]()',chr(10),'[Appendix B]()',chr(10),'[Appendix A]()',chr(10),'# Beta',chr(10),'# Alpha',chr(10),'# Appendix A',chr(10))
 WHEN 3 THEN concat('Repair_Costs:',chr(10),'Materials',chr(10),'Multiplier',chr(10),'Iron',chr(10),'x2',chr(10),'Steel',chr(10),'1.5 to 3',chr(10),'Orphan line',chr(10))
 ELSE '' END,"""

SPARK = f"""WITH base AS (
 SELECT doc_id, lang, CAST(p+1 AS BIGINT) AS line_no, line
 FROM {{docs}} LATERAL VIEW posexplode(split(text,'\\n',-1)) t AS p, line),
{DAMAGE}
SELECT doc_id, lang, {PREFACE}
 array_join(transform(array_sort(collect_list(struct(line_no,dl))), x -> x.dl), chr(10))) AS text
FROM decor GROUP BY doc_id, lang"""

DUCKDB = f"""WITH base AS (
 SELECT doc_id, lang, unnest(string_split(text,chr(10))) AS line,
  generate_subscripts(string_split(text,chr(10)),1)::BIGINT AS line_no FROM documents),
{DAMAGE}
SELECT doc_id, lang, {PREFACE}
 string_agg(dl, chr(10) ORDER BY line_no)) AS text
FROM decor GROUP BY doc_id, lang"""


def damaged_book(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, text)."""
    return docs.sparkSession.sql(SPARK, docs=docs)
