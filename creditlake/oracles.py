"""DuckDB SQL of what DataFrame operators compute, written by hand from the rules' meaning; nothing of it is shared with
them but the projection's rows."""

from __future__ import annotations

from .plans import scoring
from .plans.credit import _with, closure
from .plans.dialect import DuckDB


def _num(c: str) -> str:
    return f"(CASE WHEN regexp_full_match(trim({c}), '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?') THEN try_cast(trim({c}) AS double) END)"


def _day(c: str) -> str:
    return f"(CASE WHEN regexp_full_match({c}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN try_cast({c} AS date) WHEN regexp_full_match({c}, '[0-9]{{8}}') THEN cast(try_strptime({c}, '%Y%m%d') AS date) END)"


def _xml_day(c: str) -> str:
    return f"(regexp_full_match({c}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') AND try_cast({c} AS date) IS NOT NULL)"


def _error(table: str, section: int, ord_: int, element: str, code: str, broken: str) -> str:
    pos = "0" if section == 0 else "pos"
    return f"SELECT l, m, {section} AS section, cast({pos} AS bigint) AS pos, {ord_} AS ord, '{element}' AS element, '{code}' AS code FROM {table} WHERE {broken}"


_DECIMAL = "regexp_full_match({}, ' *[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+) *')"
_AMOUNT = "NOT " + _DECIMAL
_RANGE = _DECIMAL + " AND (try_cast(trim({}) AS double) < 0 OR regexp_matches({}, '[.][0-9]{{2}}[0-9]*[1-9]'))"


def _range(c: str) -> str:
    return _RANGE.format(c, c, c)


_STRUCTURE = [
    _error("raw_header", 0, 2, "nombre_enregistrements", "E000", "NOT malformed AND NOT regexp_full_match(nombre_enregistrements, '[0-9]+')"),
    _error("raw_borrower", 1, 5, "date_naissance", "E002", f"date_naissance <> '' AND NOT {_xml_day('date_naissance')}"),
    _error("raw_borrower", 1, 8, "numero_piece", "E010", "numero_piece <> '' AND NOT regexp_full_match(numero_piece, '[A-Z]{2}-[A-Z]+-[0-9]{8}')"),
    _error("raw_borrower", 1, 10, "telephone", "E014", "NOT regexp_full_match(telephone, '[+][0-9]{11}')"),
    _error("raw_contract", 2, 2, "type_credit", "E000", "type_credit NOT IN ('court_terme', 'moyen_terme', 'long_terme', 'decouvert', 'credit_bail', 'engagement_signature')"),
    _error("raw_contract", 2, 3, "date_octroi", "E002", f"NOT {_xml_day('date_octroi')}"),
    _error("raw_contract", 2, 4, "date_echeance", "E002", f"NOT {_xml_day('date_echeance')}"),
    _error("raw_contract", 2, 5, "montant_octroye", "E003", f"{_AMOUNT.format('montant_octroye')} OR {_range('montant_octroye')}"),
    _error("raw_contract", 2, 6, "devise", "E006", "devise <> 'XOF'"),
    _error("raw_contract", 2, 12, "encours", "E003", _AMOUNT.format("encours")),
    _error("raw_contract", 2, 12, "encours", "E004", _range("encours")),
    _error("raw_contract", 2, 13, "montant_impaye", "E003", f"{_AMOUNT.format('montant_impaye')} OR {_range('montant_impaye')}"),
    _error("raw_contract", 2, 10, "montant_garantie", "E003", f"{_AMOUNT.format('montant_garantie')} OR {_range('montant_garantie')}"),
    _error("raw_contract", 2, 14, "jours_retard", "E000", "NOT regexp_full_match(jours_retard, '[0-9]+')"),
]


def _finding(table: str, entity: str, code: str, severity: str, field: str, broken: str, value: str | None = None) -> str:
    ident = {"contrat": "id_contrat_source", "emprunteur": "id_emprunteur_source", "entete": "declarant"}[entity]
    champ = field if field.startswith("CASE") else f"'{field}'"
    return f"SELECT l, m, '{entity}' AS entite, {ident} AS identifiant, {champ} AS champ, '{code}' AS code, '{severity}' AS severite, {value or field} AS valeur_recue FROM {table} c WHERE {broken}"


def _two(code: str, a: str, b: str, parse) -> str:
    bad_a = f"({a} <> '' AND {parse(a)} IS NULL)"
    return _finding("loans", "contrat", code, "BLOQUANT", f"CASE WHEN {bad_a} THEN '{a}' ELSE '{b}' END", f"{bad_a} OR ({b} <> '' AND {parse(b)} IS NULL)", f"CASE WHEN {bad_a} THEN {a} ELSE {b} END")


_AGE = f"date_diff('day', {_day('date_naissance')}, cast(ref AS date)) / 365.25"
_ROWS = [
    _finding("people", "emprunteur", "E001", "BLOQUANT", "CASE WHEN type_personne = 'PP' THEN 'nom' ELSE 'raison_sociale' END", "CASE WHEN type_personne = 'PP' THEN trim(nom) ELSE trim(raison_sociale) END = ''", "CASE WHEN type_personne = 'PP' THEN nom ELSE raison_sociale END"),
    _finding("people", "emprunteur", "E002", "BLOQUANT", "date_naissance", f"date_naissance <> '' AND {_day('date_naissance')} IS NULL"),
    _finding("people", "emprunteur", "E010", "MAJEUR", "numero_piece", "numero_piece <> '' AND NOT regexp_full_match(numero_piece, '[A-Z]{2}-[A-Z]+-[0-9]{8}')"),
    _finding("people", "emprunteur", "E011", "MAJEUR", "date_naissance", f"{_AGE} < 18 OR {_AGE} > 100"),
    _finding("people", "emprunteur", "E014", "MINEUR", "telephone", "telephone <> '' AND NOT regexp_full_match(telephone, '[+][0-9]{11}')"),
    _finding("people", "emprunteur", "E015", "MAJEUR", "nif", "type_personne = 'PM' AND trim(nif) = ''"),
    _two("E002", "date_octroi", "date_echeance", _day),
    _two("E003", "montant_octroye", "encours", _num),
    _finding("loans", "contrat", "E004", "BLOQUANT", "encours", f"{_num('encours')} < 0"),
    _finding("loans", "contrat", "E005", "MAJEUR", "encours", f"{_num('encours')} > {_num('montant_octroye')}"),
    _finding("loans", "contrat", "E006", "MAJEUR", "devise", "devise <> 'XOF'"),
    _finding("loans", "contrat", "E007", "BLOQUANT", "date_echeance", f"{_day('date_echeance')} < {_day('date_octroi')}"),
    _finding("loans", "contrat", "E008", "BLOQUANT", "id_emprunteur_source", "NOT EXISTS (SELECT 1 FROM people p WHERE p.l = c.l AND p.m = c.m AND p.id_emprunteur_source = c.id_emprunteur_source)"),
    _finding("loans", "contrat", "E009", "BLOQUANT", "id_contrat_source", "EXISTS (SELECT 1 FROM loans p WHERE p.l = c.l AND p.m = c.m AND p.id_contrat_source = c.id_contrat_source AND p.pos < c.pos)"),
    _finding("loans", "contrat", "E012", "MAJEUR", "classification", "CASE WHEN try_cast(jours_retard AS bigint) = 0 THEN 'sain' WHEN try_cast(jours_retard AS bigint) <= 30 THEN 'sensible' WHEN try_cast(jours_retard AS bigint) <= 90 THEN 'douteux' WHEN try_cast(jours_retard AS bigint) > 90 THEN 'contentieux' END <> classification"),
    _finding("heads", "entete", "E013", "BLOQUANT", "code_declarant", "vetoed"),
    "SELECT l, m, 'fichier', '?', '?', 'E000', 'BLOQUANT', '' FROM heads WHERE NOT sound",
    "SELECT e.l, e.m, 'fichier', '?', '?', 'E000', 'BLOQUANT', '' FROM file_errors e JOIN heads h ON e.l = h.l AND e.m = h.m WHERE sound AND code = 'E000'",
]
_NORMAL = "array_to_string(list_filter(string_split_regex(regexp_replace(upper(strip_accents({})), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+'), lambda w: w <> '' AND w NOT IN ('DE', 'DU', 'DES', 'LA', 'LE', 'EL', 'BEN', 'BINTI', 'BIN', 'AL')), ' ')"
_IDENT = "regexp_replace(upper({}), '[\\s-]', '', 'g')"


def _squeezed(x: str) -> str:
    for letter in "BCDFGHJKLMNPQRSTVWXZ0123456789":
        x = f"regexp_replace({x}, '{letter}+', '{letter}', 'g')"
    return x


_SOUND = "replace(replace(replace(mot, 'PH', 'F'), 'Q', 'K'), 'C', 'K')"
_PHON = f"substr({_SOUND}, 1, 1) || {_squeezed(f'regexp_replace(substr({_SOUND}, 2), ' + chr(39) + '[AEIOUY]' + chr(39) + ', ' + chr(39) * 2 + ', ' + chr(39) + 'g' + chr(39) + ')')}"
_KEY = "l, m"
_STEPS = {
    "file_errors": " UNION ALL ".join(_STRUCTURE),
    "first_errors": "SELECT l, m, first(code ORDER BY section, pos, ord) AS first_code FROM file_errors GROUP BY l, m",
    "heads": "SELECT h.*, f.first_code, NOT malformed AND coalesce(f.first_code <> 'E000', true) AS sound, NOT malformed AND coalesce(f.first_code <> 'E000', true) AND h.code_declarant NOT IN (SELECT code_declarant FROM lenders) AS vetoed FROM raw_header h LEFT JOIN first_errors f ON h.l = f.l AND h.m = f.m",
    "people": "SELECT b.*, h.date_arrete AS ref, h.vetoed FROM raw_borrower b JOIN heads h ON b.l = h.l AND b.m = h.m WHERE h.sound",
    "loans": "SELECT c.*, h.vetoed FROM raw_contract c JOIN heads h ON c.l = h.l AND c.m = h.m WHERE h.sound",
    "found": " UNION ALL ".join(_ROWS),
    "decisions": "SELECT c.*, CASE WHEN vetoed OR EXISTS (SELECT 1 FROM found f WHERE f.l = c.l AND f.m = c.m AND f.identifiant = c.id_contrat_source AND f.severite = 'BLOQUANT') THEN 'REJETE' WHEN EXISTS (SELECT 1 FROM found f WHERE f.l = c.l AND f.m = c.m AND f.identifiant = c.id_contrat_source) THEN 'ACCEPTE_AVEC_RESERVE' ELSE 'ACCEPTE' END AS decision FROM loans c",
    "counted": "SELECT l, m, count(*) AS contrats, count(*) FILTER (decision = 'ACCEPTE') AS acceptes, count(*) FILTER (decision = 'ACCEPTE_AVEC_RESERVE') AS reserves, count(*) FILTER (decision = 'REJETE') AS rejetes FROM decisions GROUP BY l, m",
    "report": "SELECT h.l, h.m, CASE WHEN sound THEN declarant ELSE '?' END AS declarant, coalesce(p.n, 0) AS emprunteurs, coalesce(contrats, 0) AS contrats, coalesce(acceptes, 0) AS acceptes, coalesce(reserves, 0) AS reserves, coalesce(rejetes, 0) AS rejetes, coalesce(round(cast(acceptes + reserves AS double) / contrats, 6), 0) AS taux, NOT sound OR vetoed AS fichier_rejete FROM heads h LEFT JOIN counted c ON h.l = c.l AND h.m = c.m LEFT JOIN (SELECT l, m, count(*) AS n FROM people GROUP BY l, m) p ON h.l = p.l AND h.m = p.m",
    "named": f"SELECT cle, CASE WHEN type_personne = 'PP' THEN {_IDENT.format('numero_piece')} ELSE {_IDENT.format('nif')} END AS ident, CASE WHEN type_personne = 'PP' THEN concat_ws(' ', nullif({_NORMAL.format('nom')}, ''), nullif({_NORMAL.format('prenom')}, '')) ELSE {_NORMAL.format('raison_sociale')} END AS nom_complet, date_naissance AS naissance FROM borrower",
    "worded": "SELECT *, split_part(nom_complet, ' ', 1) AS mot FROM named",
    "sounded": f"SELECT *, CASE WHEN mot = '' THEN '' ELSE {_PHON} END AS phon FROM worded",
    "blocked": "SELECT cle, concat('PIECE:', ident) AS bk FROM sounded WHERE ident <> '' UNION SELECT cle, concat('NAISS:', naissance, ':', substr(mot, 1, 1)) FROM sounded WHERE mot <> '' AND naissance <> '' UNION SELECT cle, concat('PHON:', phon, ':', substr(naissance, 1, 4)) FROM sounded WHERE mot <> '' AND naissance <> ''",
}
_FINDING = "SELECT l, m, identifiant, code, champ, severite, valeur_recue FROM found WHERE entite = '{}'"
_ONE = "SELECT l, m, identifiant, champ, valeur_recue FROM found WHERE code = '{}'"
# The rule catalogue.
_CATALOGUE = "('E001', 'BLOQUANT', 'emprunteur'), ('E002', 'BLOQUANT', 'emprunteur, contrat'), ('E003', 'BLOQUANT', 'contrat'), ('E004', 'BLOQUANT', 'contrat'), ('E005', 'MAJEUR', 'contrat'), ('E006', 'MAJEUR', 'contrat'), ('E007', 'BLOQUANT', 'contrat'), ('E008', 'BLOQUANT', 'contrat'), ('E009', 'BLOQUANT', 'contrat'), ('E010', 'MAJEUR', 'emprunteur'), ('E011', 'MAJEUR', 'emprunteur'), ('E012', 'MAJEUR', 'contrat'), ('E013', 'BLOQUANT', 'entete'), ('E014', 'MINEUR', 'emprunteur'), ('E015', 'MAJEUR', 'emprunteur')"
_LOADED = "SELECT * FROM decisions WHERE decision <> 'REJETE'"
_MISSING = "SELECT '{0}' AS champ, count(*) FILTER ({1} = '') AS nb_manquants, round(1 - count(*) FILTER ({1} = '') / cast(count(*) AS double), 6) AS taux_completude FROM {2}"
_PLANS = {
    "v_rules_contract": _FINDING.format("contrat"),
    "v_rules_borrower": _FINDING.format("emprunteur"),
    "v_structural_kept": _FINDING.format("fichier"),
    "v_orphan_borrower": _ONE.format("E008"),
    "v_duplicate_contract": _ONE.format("E009"),
    "v_unknown_lender": _ONE.format("E013"),
    "v_structural_errors": "SELECT l, m, section, pos, element, code FROM file_errors",
    "v_first_error_gate": "SELECT l, m, malformed, first_code, sound FROM heads",
    "v_header_veto": "SELECT l, m, decision, count(*) AS n FROM decisions WHERE vetoed GROUP BY ALL",
    "v_decision": "SELECT l, m, pos, id_contrat_source, decision FROM decisions",
    "v_file_report": "SELECT * FROM report",
    "v_lender_decisions": "SELECT l, decision, count(*) AS n FROM decisions GROUP BY ALL",
    "v_detection_recall": "SELECT code, injected, found, round(cast(found AS double) / injected, 6) AS rappel FROM (SELECT coalesce(t.code, '*') AS code, count(*) AS injected, count(f.code) AS found FROM (SELECT DISTINCT * FROM truth) t LEFT JOIN (SELECT DISTINCT l, entite, identifiant, champ, code FROM found) f ON t.l = f.l AND t.entite = f.entite AND t.ident = f.identifiant AND t.champ = f.champ AND t.code = f.code GROUP BY GROUPING SETS ((t.code), ())) x",
    "q_catalogue": f"SELECT * FROM (VALUES {_CATALOGUE}) AS t(code, severite, entites)",
    "q_rejections": "SELECT l, m, entite, identifiant AS ligne, champ, code, severite, valeur_recue FROM found",
    "q_lender_ranking": "SELECT r.l, q.qualite, sum(contrats) AS contrats, coalesce(round(cast(sum(rejetes) AS double) / nullif(sum(contrats), 0), 6), 0) AS taux_rejet, coalesce(round(cast(sum(reserves) AS double) / nullif(sum(contrats), 0), 6), 0) AS taux_reserve FROM report r JOIN lenders q ON r.l = q.l GROUP BY r.l, q.qualite",
    "q_top_errors": f"SELECT code, n, coalesce(severite, 'BLOQUANT') AS severite FROM (SELECT code, count(*) AS n FROM found GROUP BY code ORDER BY n DESC, code LIMIT 10) x LEFT JOIN (VALUES {_CATALOGUE}) AS t(code, severite, entites) USING (code)",
    "q_severity_split": "SELECT severite, coalesce(n, 0) AS n, round(cast(coalesce(n, 0) AS double) / sum(coalesce(n, 0)) OVER (), 6) AS part FROM (VALUES ('BLOQUANT'), ('MAJEUR'), ('MINEUR')) AS t(severite) LEFT JOIN (SELECT severite, count(*) AS n FROM found GROUP BY severite) USING (severite)",
    "q_monthly_grid": "SELECT p.qualite, g.m, coalesce(round(cast(x.rejetes AS double) / nullif(x.contrats, 0), 6), 0) AS taux FROM (SELECT DISTINCT qualite FROM lenders) p CROSS JOIN months g LEFT JOIN (SELECT qualite, m, sum(rejetes) AS rejetes, sum(contrats) AS contrats FROM report JOIN lenders USING (l) WHERE declarant <> '?' GROUP BY qualite, m) x ON x.qualite = p.qualite AND x.m = g.m",
    "q_completeness": " UNION ALL ".join(
        [_MISSING.format("identite_principale", "CASE WHEN type_personne = 'PP' THEN nom ELSE raison_sociale END", "raw_borrower"), _MISSING.format("piece_identification", "CASE WHEN type_personne = 'PP' THEN numero_piece ELSE nif END", "raw_borrower"), _MISSING.format("telephone", "telephone", "raw_borrower")]
        + [_MISSING.format(c, c, "raw_contract") for c in ("date_octroi", "date_echeance", "montant_octroye", "encours", "classification")]
    ),
    "q_global_totals": "SELECT count(*) AS fichiers, count(*) FILTER (fichier_rejete) AS fichiers_rejetes, sum(emprunteurs) AS emprunteurs, sum(contrats) AS contrats, sum(acceptes) AS acceptes, sum(reserves) AS reserves, sum(rejetes) AS rejetes, min(m) AS debut, max(m) AS fin FROM report",
    "q_file_top_codes": "SELECT l, m, code, n FROM (SELECT l, m, code, count(*) AS n FROM found GROUP BY ALL) x QUALIFY row_number() OVER (PARTITION BY l, m ORDER BY n DESC, code) <= 5",
    "q_months_seen": "SELECT m, count(*) AS fichiers, sum(contrats) AS contrats FROM report GROUP BY m",
    "l_lenders_new": "SELECT DISTINCT code_declarant FROM raw_header WHERE code_declarant IN (SELECT code_declarant FROM lenders WHERE qualite <> 'excellent')",
    "l_borrowers_loaded": f"SELECT DISTINCT p.l, p.id_emprunteur_source FROM people p JOIN ({_LOADED}) c ON p.l = c.l AND p.m = c.m AND p.id_emprunteur_source = c.id_emprunteur_source",
    "l_new_rows": f"SELECT l, id_contrat_source, min(m) AS m FROM ({_LOADED}) x GROUP BY l, id_contrat_source HAVING min(m) >= 6",
    "l_typed": f"SELECT l, m, id_contrat_source, {_day('date_octroi')} AS date_octroi, cast(cast({_num('montant_octroye')} AS decimal(18, 2)) AS double) AS montant_octroye, cast(cast({_num('encours')} AS decimal(18, 2)) AS double) AS encours, try_cast(jours_retard AS int) AS jours_retard, classification FROM ({_LOADED}) x",
    "i_normalise": "SELECT cle, ident, nom_complet, naissance FROM named",
    "i_phonetic": "SELECT cle, mot, phon FROM sounded",
    "i_block_keys": "SELECT cle, bk FROM blocked",
    "i_block_sizes": "SELECT taille, count(*) AS n FROM (SELECT bk, count(*) AS taille FROM blocked GROUP BY bk) x GROUP BY taille",
    "i_pairs": "SELECT DISTINCT x.cle AS a, y.cle AS z FROM blocked x JOIN blocked y ON x.bk = y.bk AND x.cle < y.cle",
    "s_score_woe": "SELECT b, score, facteurs FROM scored JOIN (SELECT b, string_agg(variable, ',' ORDER BY abs(points) DESC, variable) AS facteurs FROM (SELECT *, row_number() OVER (PARTITION BY b ORDER BY abs(points) DESC, variable) AS nth FROM points9) p WHERE nth <= 3 GROUP BY b) f USING (b)",
}
_ALL = _with(DuckDB()) | scoring.steps(DuckDB()) | _STEPS
ORACLES = {name: closure(_ALL, body) for name, body in _PLANS.items()}
