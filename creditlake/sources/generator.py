"""Synthetic lenders' data: every draw is a hash of seed, purpose and key, so plans need no shared state and reruns agree."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrears_class
from ..plans.credit import CREDIT_TYPES, FIRST_NAMES, HEADS, LENDERS, MONTH_ENDS, PERIODS, SECURITIES, TAILS
from .declarations import BORROWER, CONTRACT, HEADER, to_xml

# Shares of records with an injected anomaly by quality of the lender, months of each type of credit, codes.
RATES = {"excellent": 0.01, "moyen": 0.08, "defaillant": 0.25}
DURATIONS = {"court_terme": (3, 12), "moyen_terme": (13, 48), "long_terme": (49, 180), "decouvert": (1, 12), "credit_bail": (24, 60), "engagement_signature": (6, 36)}
AMOUNTS = (200_000, 25_000_000)
BORROWER_CODES = ["E001", "E002", "E010", "E011", "E014"]
CONTRACT_CODES = ["E002", "E003", "E004", "E005", "E006", "E007", "E008", "E012"]
COMPANIES = ["Sahel Négoce", "Niger Transit", "Delta Textile", "Aïr Services"]
TOWNS = ["Niamey", "Zinder", "Maradi", "Agadez"]
KEYS = ["l", "m"]


def draw(seed: int, purpose: str, *key: str) -> Column:
    """Uniform in [0, 1)."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(purpose), *key), F.lit(1 << 30)) / F.lit(float(1 << 30))


def _below(n: int, seed: int, purpose: str, *key: str) -> Column:
    return F.floor(draw(seed, purpose, *key) * n).cast("int")


def _of(values: list[str], at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), at + 1)


def _lender(values: list) -> Column:
    """A value for each lender number."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), F.col("l").cast("int") + 1)


def lenders(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, c, t, q) for k, (c, t, q) in enumerate(LENDERS)], "l int, code_declarant string, type_etablissement string, qualite string")


def borrowers(spark: SparkSession, n: int, seed: int) -> DataFrame:
    """About n records of n / 1.3 identities: 80 % persons; 15 % are known to one to three more lenders, in other spellings.

    `identite` is the truth. Fewer than n records are topped up with new identities, so there are at least n.
    """
    base = int(n / 1.3)

    def people(lo: int, hi: int, copies: bool) -> DataFrame:
        ids = spark.range(lo, hi).withColumnRenamed("id", "identite").withColumn("home", _below(len(LENDERS), seed, "lender", "identite"))
        more = F.when(draw(seed, "shared", "identite") < 0.15, 1 + _below(3, seed, "copies", "identite")).otherwise(0) if copies else F.lit(0)
        stride = F.element_at(F.array(F.lit(1), F.lit(5), F.lit(7)), 1 + _below(3, seed, "stride", "identite"))  # prime to the lenders' number
        return ids.withColumn("copy", F.explode(F.sequence(F.lit(0), more))).withColumn("l", F.pmod(F.col("home") + F.col("copy") * stride, F.lit(len(LENDERS))))

    first = people(0, base, True)
    short = n - first.count()
    rows = first if short <= 0 else first.unionByName(people(base, base + short, False))
    kind = F.when(draw(seed, "kind", "identite") < 0.8, "PP").otherwise("PM")
    rows = rows.withColumn("type_personne", kind).withColumn("spelling", F.when(F.col("copy") == 0, 0).otherwise(1 + _below(4, seed, "spelling", "identite", "copy")))
    nom = F.concat(_of(HEADS, _below(len(HEADS), seed, "head", "identite")), _of(TAILS, _below(len(TAILS), seed, "tail", "identite")))
    prenom = _of(FIRST_NAMES, _below(len(FIRST_NAMES), seed, "prenom", "identite"))
    born = F.date_add(F.lit("1950-01-01").cast("date"), _below(18_000, seed, "born", "identite"))
    pp, v, number = F.col("type_personne") == "PP", F.col("spelling"), F.lpad(F.col("identite").cast("string"), 8, "0")
    return rows.select(
        "identite",
        "l",
        F.concat(F.lit("EMP"), number, F.col("copy").cast("string")).alias("id_emprunteur_source"),
        "type_personne",
        F.when(pp, F.when(v == 1, F.upper(nom)).when(v == 2, prenom).otherwise(nom)).otherwise("").alias("nom"),
        F.when(pp, F.when(v == 2, nom).when(v == 3, F.concat(F.substring(prenom, 1, 1), F.lit("."))).otherwise(prenom)).otherwise("").alias("prenom"),
        F.when(pp, F.lit("")).otherwise(F.concat(_of(COMPANIES, _below(len(COMPANIES), seed, "raison", "identite")), F.lit(" "), F.col("identite").cast("string"))).alias("raison_sociale"),
        F.when(pp, F.date_format(F.when(v == 4, F.date_add(born, 1)).otherwise(born), "yyyy-MM-dd")).otherwise("").alias("date_naissance"),
        F.when(pp, F.when(draw(seed, "sexe", "identite") < 0.5, "F").otherwise("M")).otherwise("").alias("sexe"),
        F.when(pp, "CNI").otherwise("").alias("type_piece"),
        F.when(pp, F.concat(F.lit("NE-CNI-"), number)).otherwise("").alias("numero_piece"),
        F.when(pp, F.lit("")).otherwise(F.concat(F.lit("NIF"), F.col("identite").cast("string"))).alias("nif"),
        F.concat(F.lit("+227"), F.lpad(F.col("identite").cast("string"), 8, "9")).alias("telephone"),
        _of(TOWNS, _below(len(TOWNS), seed, "ville", "identite")).alias("ville"),
        F.lit("NE").alias("pays"),
    )


def contracts(people: DataFrame, n: int, records: int, seed: int) -> DataFrame:
    """About n contracts: each record gets the whole part of n / records and one more by its draw. Cents, dates, guarantee."""
    each = n / max(1, records)
    got = F.lit(int(each)) + (draw(seed, "one more", "l", "id_emprunteur_source") < each - int(each)).cast("int")
    rows = people.select("l", "id_emprunteur_source", "identite").withColumn("got", got).where("got > 0").withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("got")))).drop("got")
    rows = rows.withColumn("id_contrat_source", F.concat(F.lit("CNT"), F.substring("id_emprunteur_source", 4, 99), F.lit("-"), F.col("nth").cast("string"))).drop("nth")
    key = ("l", "id_contrat_source")
    rows = rows.withColumn("type_credit", _of(CREDIT_TYPES, _below(len(CREDIT_TYPES), seed, "type", *key)))
    lo, hi = (F.element_at(F.create_map(*[F.lit(x) for k, v in DURATIONS.items() for x in (k, v[at])]), F.col("type_credit")) for at in (0, 1))
    months = (lo + F.floor(draw(seed, "months", *key) * (hi - lo + 1))).cast("int")
    start, span = F.lit(MONTH_ENDS[0]).cast("date"), F.datediff(F.lit(MONTH_ENDS[-1]).cast("date"), F.lit(MONTH_ENDS[0]).cast("date"))
    octroi = F.when(draw(seed, "before", *key) < 0.5, F.date_sub(start, _below(901, seed, "age", *key))).otherwise(F.date_add(start, F.floor(draw(seed, "inside", *key) * (span + 1)).cast("int")))
    cents = F.round((AMOUNTS[0] + draw(seed, "amount", *key) * (AMOUNTS[1] - AMOUNTS[0])) * 100).cast("long")
    rows = rows.withColumn("date_octroi", octroi).withColumn("date_echeance", F.add_months("date_octroi", months)).withColumn("cents", cents)
    covered = F.when(draw(seed, "secured", *key) < 0.6, F.round(F.col("cents") * 1.2 * draw(seed, "cover", *key))).otherwise(0).cast("long")
    rows = rows.withColumn("garantie_c", covered).withColumn("taux_c", F.round(500 + 1000 * draw(seed, "rate", *key)).cast("long"))
    return rows.withColumn("periodicite", _of(PERIODS, _below(len(PERIODS), seed, "period", *key))).withColumn("type_garantie", _of(SECURITIES, _below(len(SECURITIES), seed, "security", *key)))


def snapshots(loans: DataFrame, seed: int) -> DataFrame:
    """A row for each month end between grant and maturity: linear amortisation with noise; 20 % fall into arrears at a
    drawn one of their months and gain 15 to 35 days each month from then on, 365 at most."""
    key = ("l", "id_contrat_source")
    days = F.array(*[F.lit(x).cast("date") for x in MONTH_ENDS])
    active = F.filter(F.transform(days, lambda d, m: F.struct(m.alias("m"), d.alias("date_arrete"))), lambda x: (x["date_arrete"] >= F.col("date_octroi")) & (x["date_arrete"] <= F.col("date_echeance")))
    rows = loans.withColumn("active", active).where(F.size("active") > 0)
    falls = F.when(draw(seed, "default", *key) < 0.2, F.floor(draw(seed, "falls", *key) * F.size("active")).cast("int"))
    # A month's count is the sum of the steps so far: steps are positive, so the bound can wait until the end.
    step = lambda k: 15 + F.pmod(F.xxhash64(F.lit(seed), F.lit("step"), *key, k), F.lit(21))
    late = F.transform(F.sequence(F.lit(0), F.size("active") - 1), lambda k: F.when(F.col("falls").isNull() | (k < F.col("falls")), F.lit(0).cast("long")).otherwise(F.least(F.lit(365).cast("long"), F.aggregate(F.sequence(F.col("falls"), F.greatest(k, F.col("falls"))), F.lit(0).cast("long"), lambda acc, x: acc + step(x)))))
    rows = rows.withColumn("falls", falls).withColumn("late", late).withColumn("at", F.explode(F.arrays_zip("active", "late")))
    rows = rows.select(*loans.columns, F.col("at.active.m").cast("int").alias("m"), F.col("at.active.date_arrete").alias("date_arrete"), F.col("at.late").cast("int").alias("jours_retard"))
    life = F.greatest(F.datediff("date_echeance", "date_octroi"), F.lit(1))
    left = F.col("cents") * F.datediff("date_echeance", "date_arrete") / life * (0.97 + 0.03 * draw(seed, "noise", *key, "m"))
    rows = rows.withColumn("encours_c", F.greatest(F.lit(0), F.round(left)).cast("long"))
    unpaid = F.when(F.col("jours_retard") > 0, F.round(F.col("encours_c") * (0.05 + 0.25 * draw(seed, "unpaid", *key, "m")))).otherwise(0)
    return rows.withColumn("impaye_c", unpaid.cast("long")).withColumn("classification", arrears_class(F.col("jours_retard")))


@dataclass(frozen=True)
class Declarations:
    """headers (l, m, declarant, malformed, header fields), borrowers and contracts (l, m, pos, fields), all fields text."""

    headers: DataFrame
    borrowers: DataFrame
    contracts: DataFrame


def _text(c: str) -> Column:
    return F.concat(F.floor(F.col(c) / 100).cast("string"), F.lit("."), F.lpad((F.col(c) % 100).cast("string"), 2, "0"))


def assemble(people: DataFrame, snaps: DataFrame) -> Declarations:
    """A file for each lender and month with snapshots: its contracts, and each of their borrowers once. The number of
    records is that of both. Snapshots of unknown borrowers count as an error of the caller and bring in no borrower."""
    iso = lambda c: F.date_format(c, "yyyy-MM-dd")
    texts = {"date_octroi": iso("date_octroi"), "date_echeance": iso("date_echeance"), "date_arrete": iso("date_arrete"), "montant_octroye": _text("cents"), "devise": F.lit("XOF"), "taux_interet": _text("taux_c"), "montant_garantie": _text("garantie_c"), "encours": _text("encours_c"), "montant_impaye": _text("impaye_c"), "jours_retard": F.col("jours_retard").cast("string")}
    pos = lambda c: F.xxhash64(c)
    loans = snaps.select(*KEYS, pos("id_contrat_source").alias("pos"), *[texts.get(n, F.col(n)).alias(n) for n in CONTRACT])
    there = snaps.select(*KEYS, "id_emprunteur_source").distinct()
    who = there.join(people, ["l", "id_emprunteur_source"]).select(*KEYS, pos("id_emprunteur_source").alias("pos"), *BORROWER)
    counts = loans.groupBy(*KEYS).agg(F.count("*").alias("n")).join(who.groupBy(*KEYS).agg(F.count("*").alias("b")), KEYS, "left")
    code = _lender([c for c, _, _ in LENDERS])
    head = {"code_declarant": code, "date_arrete": F.element_at(F.array(*[F.lit(x) for x in MONTH_ENDS]), F.col("m") + 1), "nombre_enregistrements": (F.col("n") + F.coalesce("b", F.lit(0))).cast("string"), "horodatage": F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss")}
    return Declarations(counts.select(*KEYS, code.alias("declarant"), F.lit(False).alias("malformed"), *[head[n].alias(n) for n in HEADER]), who, loans)


def _rate() -> Column:
    return _lender([RATES[q] for _, _, q in LENDERS])


def inject(clean: Declarations, seed: int) -> tuple[Declarations, DataFrame]:
    """The declarations with anomalies, and their log (declarant, entite, ligne, champ, code). By the lender's rate a record
    has one anomaly; a file with two contracts gets another one's identifier for one of its contracts; a header an unknown
    code. A borrower's E015 hits companies alone."""
    code = _lender([c for c, _, _ in LENDERS])
    hit = lambda purpose, *key: draw(seed, purpose, *KEYS, *key) < _rate()

    b = clean.borrowers
    pm, key = F.col("type_personne") == "PM", "id_emprunteur_source"
    n = F.when(pm, len(BORROWER_CODES) + 1).otherwise(len(BORROWER_CODES))
    b = b.withColumn("code", F.when(hit("borrower", key), F.element_at(F.array(*[F.lit(c) for c in [*BORROWER_CODES, "E015"]]), F.floor(draw(seed, "borrower code", *KEYS, key) * n).cast("int") + 1)))
    years = F.when(draw(seed, "age", *KEYS, key) < 0.5, 5).otherwise(110)
    values = {"E002": ("date_naissance", F.lit("31/02/2020")), "E010": ("numero_piece", F.lit("PIECE-INVALIDE")), "E011": ("date_naissance", F.date_format(F.add_months(F.lit(MONTH_ENDS[-1]).cast("date"), -12 * years), "yyyy-MM-dd")), "E014": ("telephone", F.lit("0612345678")), "E015": ("nif", F.lit(""))}
    field = F.when(F.col("code") == "E001", F.when(pm, "raison_sociale").otherwise("nom"))
    value = F.when(F.col("code") == "E001", F.lit(""))
    for c, (f, v) in values.items():
        field, value = field.when(F.col("code") == c, f), value.when(F.col("code") == c, v)
    b = b.withColumn("champ", field).withColumn("value", value)
    truth = b.where("code IS NOT NULL").select(code.alias("declarant"), F.lit("emprunteur").alias("entite"), F.col(key).alias("ligne"), "champ", "code")
    b = b.select(*KEYS, "pos", *[F.when(F.col("champ") == f, F.col("value")).otherwise(F.col(f)).alias(f) for f in BORROWER])

    c, key = clean.contracts, "id_contrat_source"
    c = c.withColumn("code", F.when(hit("contract", key), _of(CONTRACT_CODES, _below(len(CONTRACT_CODES), seed, "contract code", *KEYS, key))))
    coin = draw(seed, "which", *KEYS, key) < 0.5
    other = F.array_except(F.array(*[F.lit(x) for x in ("sain", "sensible", "douteux", "contentieux")]), F.array("classification"))
    values = {
        "E002": (F.when(coin, "date_octroi").otherwise("date_echeance"), F.lit("31/02/2024")),
        "E003": (F.when(coin, "montant_octroye").otherwise("encours"), F.lit("N/A")),
        "E004": (F.lit("encours"), F.concat(F.lit("-"), (F.col("encours").cast("decimal(18,2)") + 1000).cast("string"))),
        "E005": (F.lit("encours"), (F.col("montant_octroye").cast("decimal(18,2)") * 3 / 2).cast("decimal(18,2)").cast("string")),
        "E006": (F.lit("devise"), _of(["EUR", "USD", "GHS"], _below(3, seed, "currency", *KEYS, key))),
        "E007": (F.lit("date_echeance"), F.date_format(F.date_sub(F.col("date_octroi").cast("date"), 30), "yyyy-MM-dd")),
        "E008": (F.lit("id_emprunteur_source"), F.lit("EMP999999")),
        "E012": (F.lit("classification"), F.element_at(other, _below(3, seed, "class", *KEYS, key) + 1)),
    }
    field, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for x, (f, v) in values.items():
        field, value = F.when(F.col("code") == x, f).otherwise(field), F.when(F.col("code") == x, v).otherwise(value)
    c = c.withColumn("champ", field).withColumn("value", value)
    truth = truth.unionByName(c.where("code IS NOT NULL").select(code.alias("declarant"), F.lit("contrat").alias("entite"), F.col(key).alias("ligne"), "champ", "code"))
    c = c.select(*KEYS, "pos", *[F.when(F.col("champ") == f, F.col("value")).otherwise(F.col(f)).alias(f) for f in CONTRACT])
    # The two contracts that share an identifier are those with the least draws of their file: one row each file.
    least = c.groupBy(*KEYS).agg(F.min(F.struct(F.xxhash64(F.lit(seed), key), key)).alias("a"), F.max(F.struct(F.xxhash64(F.lit(seed), key), key)).alias("z"))
    twins = least.where((F.col("a") != F.col("z")) & hit("twin")).select(*KEYS, F.col(f"a.{key}").alias("shown"), F.col(f"z.{key}").alias(key))
    c = c.join(twins, [*KEYS, key], "left").withColumn(key, F.coalesce("shown", key)).select(*KEYS, "pos", *CONTRACT)
    truth = truth.unionByName(twins.select(code.alias("declarant"), F.lit("contrat").alias("entite"), F.col("shown").alias("ligne"), F.lit(key).alias("champ"), F.lit("E009").alias("code")))

    h = clean.headers.withColumn("bad", hit("header"))
    truth = truth.unionByName(h.where("bad").select("declarant", F.lit("entete").alias("entite"), F.col("declarant").alias("ligne"), F.lit("code_declarant").alias("champ"), F.lit("E013").alias("code")))
    wrong = F.concat(F.lit("XX"), (1000 + _below(9000, seed, "unknown", *KEYS)).cast("string"))
    return Declarations(h.withColumn("code_declarant", F.when(F.col("bad"), wrong).otherwise(F.col("code_declarant"))).drop("bad"), b, c), truth


def xml_files(d: Declarations) -> DataFrame:
    """(file, content): <lender>_<day>.xml for each header. The format has a lender's month in one document, so a file's
    records meet in one task."""
    nested = lambda df, names, as_: df.groupBy(*KEYS).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", F.struct(*names).alias("r")))), lambda x: x["r"]).alias(as_))
    rows = d.headers.join(nested(d.borrowers, BORROWER, "emprunteurs"), KEYS, "left").join(nested(d.contracts, CONTRACT, "contrats"), KEYS, "left")
    name = F.concat("declarant", F.lit("_"), F.replace("date_arrete", F.lit("-"), F.lit("")), F.lit(".xml"))
    none = lambda names: F.array().cast("array<struct<" + ", ".join(f"{n}: string" for n in names) + ">>")
    return to_xml(rows.select(name.alias("file"), F.struct(*HEADER).alias("entete"), F.coalesce("emprunteurs", none(BORROWER)).alias("emprunteurs"), F.coalesce("contrats", none(CONTRACT)).alias("contrats")))


def identity_truth(people: DataFrame) -> DataFrame:
    return people.select(_lender([c for c, _, _ in LENDERS]).alias("declarant"), "id_emprunteur_source", F.col("identite").alias("identite_verite"))
