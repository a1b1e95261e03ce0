"""DuckDB twins of every registered job, for the correctness gate.

The hospital tables are re-derived here in SQL from the raw test views
(independently of ``wardline.sources.fixtures``). Each query is written from
its result definition, over a few lookup relations (``who``, ``episode``,
``placed``, ``role_of``): membership as EXISTS or IN, counts and picks as
filtered aggregates. Arbitrary choices are pinned the same way as in the
Spark jobs (smallest name for an unordered pick, latest progress by date,
then progress_id). Results are compared without their order.
"""

from __future__ import annotations

from wardline.sources.schemas import KEYS, OPTIONAL_REFERENCES, REFERENCES

MAPPING = """
WITH
specialty AS (SELECT n_name AS specialty_name FROM nation),
complaint AS (SELECT printf('CMP-%03d', n_nationkey) AS complaint_code, n_name AS description FROM nation),
ward AS (
  SELECT 'WARD_' || CAST(w.n_nationkey AS VARCHAR) AS ward_name, s.n_name AS specialty_name,
         CAST(5 AS INTEGER) AS number_of_care_units
  FROM nation w LEFT JOIN nation s ON s.n_nationkey = w.n_nationkey % 20),
care_unit AS (
  SELECT DISTINCT 'CU-' || CAST(c_nationkey AS VARCHAR) || '-' || c_mktsegment AS care_unit_no,
         'WARD_' || CAST(c_nationkey AS VARCHAR) AS ward_name
  FROM customer),
bed AS (
  SELECT printf('BED-%03d', c_custkey) AS bed_no,
         'CU-' || CAST(c_nationkey AS VARCHAR) || '-' || c_mktsegment AS care_unit_no,
         CAST(CASE WHEN c_acctbal >= 0 THEN 1 ELSE 0 END AS INTEGER) AS is_occupied
  FROM customer),
patient AS (
  SELECT printf('PAT-%03d', c.c_custkey) AS patient_no, c.c_name AS patient_name,
         DATE '1940-01-01' + CAST((c.c_custkey * 37) % 20000 AS INTEGER) AS date_of_birth,
         (SELECT CAST(min(o.o_orderdate) AS DATE) FROM orders o WHERE o.o_custkey = c.c_custkey) AS date_admitted,
         'CU-' || CAST(c.c_nationkey AS VARCHAR) || '-' || c.c_mktsegment AS care_unit_no,
         printf('BED-%03d', c.c_custkey) AS bed_no
  FROM customer c),
doctor AS (
  SELECT printf('DOC-%03d', s.s_suppkey) AS staff_no, s.s_name AS name,
         CASE s.s_suppkey % 6 WHEN 0 THEN 'consultant' WHEN 1 THEN 'registrar(r)'
              WHEN 2 THEN 'assistant registrar(ar)' WHEN 3 THEN 'senior houseman(sh)'
              WHEN 4 THEN 'junior houseman(jh)' ELSE 'student(s)' END AS position,
         CASE WHEN s.s_suppkey % 10 = 9 THEN NULL
              ELSE DATE '2010-01-01' + CAST(7 * s.s_suppkey AS INTEGER) END AS date_joined_team,
         n.n_name AS specialty_name,
         CASE WHEN s.s_suppkey % 12 = 6 THEN NULL
              ELSE printf('DOC-%03d', s.s_suppkey - s.s_suppkey % 6) END AS consultant_staff_no
  FROM supplier s LEFT JOIN nation n ON n.n_nationkey = s.s_nationkey),
consultant AS (SELECT printf('DOC-%03d', s_suppkey) AS staff_no FROM supplier WHERE s_suppkey % 6 = 0),
nurse AS (
  SELECT printf('NUR-%03d', p_partkey) AS staff_no, p_name AS name,
         'WARD_' || CAST(p_partkey % 25 AS VARCHAR) AS ward_name,
         'CU-' || CAST(p_partkey % 25 AS VARCHAR) || '-' ||
           (['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'])[p_size % 5 + 1] AS care_unit_no
  FROM part),
day_sister AS (SELECT printf('NUR-%03d', p_partkey) AS staff_no FROM part WHERE p_type = 'ECONOMY'),
night_sister AS (SELECT printf('NUR-%03d', p_partkey) AS staff_no FROM part WHERE p_type = 'LARGE'),
staff_nurse AS (SELECT printf('NUR-%03d', p_partkey) AS staff_no FROM part WHERE p_type IN ('MEDIUM', 'PROMO')),
non_reg_nurse AS (SELECT printf('NUR-%03d', p_partkey) AS staff_no FROM part WHERE p_type = 'SMALL'),
treatment AS (SELECT printf('TRT-%03d', p_partkey) AS treatment_code, p_name AS description FROM part),
ptr AS (
  SELECT printf('PAT-%03d', o.o_custkey) AS patient_no,
         printf('CMP-%03d', o.o_orderkey % 25) AS complaint_code,
         printf('TRT-%03d', l.l_partkey) AS treatment_code,
         printf('DOC-%03d', l.l_suppkey) AS doctor_staff_no,
         CAST(l.l_shipdate AS DATE) AS date_started,
         CASE WHEN l.l_linestatus = 'O' THEN NULL
              ELSE CAST(l.l_shipdate AS DATE) + CAST(l.l_quantity AS INTEGER) END AS date_ended
  FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey),
previous_experience AS (
  SELECT e.event_id AS exp_id, printf('DOC-%03d', e.user_id) AS staff_no,
         CAST(e.ts AS DATE) AS from_date,
         CAST(e.ts AS DATE) + CAST(floor(e.value) AS INTEGER) AS to_date,
         'EST-' || CAST(e.event_id % 7 AS VARCHAR) AS establishment, e.event_type AS position
  FROM events e
  WHERE e.event_id % 10 = 0),
progress AS (
  SELECT e.event_id AS progress_id, printf('DOC-%03d', e.user_id) AS staff_no,
         'EST-' || CAST(e.event_id % 7 AS VARCHAR) AS establishment, e.event_type AS position,
         CAST(e.ts AS DATE) AS date,
         CASE WHEN e.value >= 100 THEN 'A' WHEN e.value >= 50 THEN 'B'
              WHEN e.value >= 20 THEN 'C' ELSE 'D' END AS performance_grade
  FROM events e
  WHERE e.event_id % 10 <> 0),
who AS (
  SELECT staff_no AS doctor_no, name AS doctor_name, position AS rank_held, specialty_name AS field,
         date_joined_team, consultant_staff_no AS leader_no,
         CASE WHEN staff_no IN (SELECT staff_no FROM consultant) THEN 'Yes' ELSE 'No' END AS is_consultant
  FROM doctor),
episode AS (
  SELECT patient_no, complaint_code, complaint, treatment_code, treatment,
         doctor_staff_no AS doctor_no, date_started, date_ended
  FROM ptr
    INNER JOIN (SELECT complaint_code, description AS complaint FROM complaint) USING (complaint_code)
    INNER JOIN (SELECT treatment_code, description AS treatment FROM treatment) USING (treatment_code)),
placed AS (
  SELECT * FROM patient INNER JOIN care_unit USING (care_unit_no)
    INNER JOIN (SELECT ward_name, specialty_name FROM ward) USING (ward_name)),
role_row AS (
  SELECT staff_no, 1 AS place, 'Day Sister' AS title FROM day_sister UNION ALL
  SELECT staff_no, 2, 'Night Sister' FROM night_sister UNION ALL
  SELECT staff_no, 3, 'Staff Nurse' FROM staff_nurse UNION ALL
  SELECT staff_no, 4, 'Non-Reg Nurse' FROM non_reg_nurse),
role_of AS (SELECT staff_no, arg_min(title, place) AS title FROM role_row GROUP BY staff_no)
"""

Q11_PARAMS = {"complaint_code": "CMP-007", "date_from": "1996-01-01", "date_to": "1996-12-31"}

QUERIES: dict[str, str] = {}

QUERIES["q1_consultant_teams"] = """
SELECT lead.doctor_no AS consultant_no, lead.doctor_name AS consultant_name, lead.field AS specialty_name,
       member.doctor_no, member.doctor_name, member.rank_held AS position, member.date_joined_team
FROM who AS member, who AS lead
WHERE lead.is_consultant = 'Yes' AND member.leader_no = lead.doctor_no
  AND member.doctor_no <> lead.doctor_no
"""

QUERIES["q2_ward_staffing"] = """
, titled AS (SELECT * FROM nurse INNER JOIN role_row USING (staff_no)),
of_ward AS (
  SELECT ward_name, min(name) FILTER (title = 'Day Sister') AS day_sister,
         min(name) FILTER (title = 'Night Sister') AS night_sister
  FROM titled GROUP BY ward_name),
of_unit AS (
  SELECT care_unit_no, min(name) AS staff_nurse_in_charge
  FROM titled WHERE title = 'Staff Nurse' GROUP BY care_unit_no)
SELECT DISTINCT ward_name, specialty_name, day_sister, night_sister, care_unit_no, staff_nurse_in_charge
FROM care_unit INNER JOIN ward USING (ward_name)
  LEFT OUTER JOIN of_ward USING (ward_name) LEFT OUTER JOIN of_unit USING (care_unit_no)
"""

QUERIES["q3_patient_treatments"] = """
SELECT patient_no, patient_name, complaint_code, complaint, treatment_code, treatment,
       doctor_name, date_started, date_ended
FROM episode INNER JOIN patient USING (patient_no) INNER JOIN who USING (doctor_no)
"""

_Q4 = """
, seen AS (
  SELECT DISTINCT doctor_staff_no AS doctor_no, patient_no FROM ptr
  WHERE doctor_staff_no IN (
    SELECT doctor_no FROM who WHERE starts_with(rank_held, 'junior houseman') OR starts_with(rank_held, 'student'))),
unit_nurse AS (SELECT DISTINCT care_unit_no, name AS staff_nurse_of_careunit FROM nurse {only})
SELECT doctor_no AS jh_no, doctor_name AS junior_doctor, rank_held AS position, patient_no, patient_name,
       care_unit_no, staff_nurse_of_careunit
FROM seen INNER JOIN who USING (doctor_no) INNER JOIN patient USING (patient_no)
  LEFT OUTER JOIN unit_nurse USING (care_unit_no)
"""
QUERIES["q4_junior_patients"] = _Q4.format(only="")
QUERIES["q4_junior_patients_strict"] = _Q4.format(
    only="WHERE EXISTS (FROM staff_nurse WHERE staff_nurse.staff_no = nurse.staff_no)")

QUERIES["q5_unique_specialty"] = """
SELECT any_value(doctor_no) AS staff_no, any_value(doctor_name) AS consultant_name, field AS specialty_name
FROM who WHERE is_consultant = 'Yes' AND field IS NOT NULL
GROUP BY field HAVING count(doctor_no) < 2
"""

QUERIES["q6_treatment_experience"] = """
, history AS (
  SELECT staff_no AS doctor_no, exp_id, from_date, to_date, establishment, position AS experience_position
  FROM previous_experience),
combination AS (SELECT DISTINCT complaint_code, complaint, treatment, doctor_no, doctor_name
                FROM episode INNER JOIN who USING (doctor_no))
SELECT * FROM combination LEFT OUTER JOIN history USING (doctor_no)
"""

_Q7 = """
, variety AS (SELECT patient_no, count(DISTINCT complaint_code) AS n FROM ptr GROUP BY patient_no)
SELECT patient_no, patient_name, complaint, treatment, date_started, date_ended
FROM variety INNER JOIN patient USING (patient_no) INNER JOIN episode USING (patient_no)
WHERE n >= {least}
"""
QUERIES["q7_multi_complaint"] = _Q7.format(least=2)
QUERIES["q7_multi_complaint_10"] = _Q7.format(least=10)

QUERIES["q8_by_complaint_treatment"] = """
SELECT complaint_code, complaint, treatment_code, treatment, patient_no, patient_name
FROM patient INNER JOIN episode USING (patient_no)
"""

QUERIES["q9_doctor_performance"] = """
SELECT doctor_no AS staff_no, doctor_name, rank_held AS current_position, field AS specialty_name,
       establishment, progress.position AS role_at_establishment, date, performance_grade
FROM progress, who WHERE doctor_no = staff_no
"""

QUERIES["q10_patient_full"] = """
SELECT patient_no, patient_name, date_of_birth, date_admitted, ward_name, specialty_name, care_unit_no,
       bed_no, doctor_no, doctor_name, is_consultant, complaint_code, complaint, treatment_code, treatment,
       date_started, date_ended
FROM episode INNER JOIN who USING (doctor_no) INNER JOIN placed USING (patient_no)
"""

QUERIES["q11_complaint_daterange"] = """
SELECT treatment_code, treatment, complaint, patient_no, patient_name, doctor_name, date_started, date_ended
FROM episode INNER JOIN who USING (doctor_no) INNER JOIN patient USING (patient_no)
WHERE complaint_code = '{complaint_code}' AND date_started BETWEEN DATE '{date_from}' AND DATE '{date_to}'
""".format(**Q11_PARAMS)

QUERIES["q12_position_counts"] = """
, spelled AS (
  SELECT * FROM (VALUES ('Day Sister', 'Day Sister'), ('Night Sister', 'Night Sister'),
    ('Staff Nurse', 'Staff Nurse'), ('Non-Reg Nurse', 'Non-Registered Nurse')) v(title, position))
SELECT rank_held AS position, count(doctor_no) AS staff_count FROM who GROUP BY rank_held
UNION ALL
SELECT position, count(staff_no) FROM spelled LEFT OUTER JOIN role_row USING (title) GROUP BY position
"""


# --- record forms (batch: every key, key column carried) -------------------

QUERIES["rec_patient_header"] = """
SELECT patient_no, patient_name, date_of_birth, date_admitted, care_unit_no, bed_no, ward_name, specialty_name
FROM placed
"""

QUERIES["rec_patient_history"] = """
SELECT patient_no, complaint_code, complaint, treatment_code, treatment, doctor_no, doctor_name,
       is_consultant, date_started, date_ended
FROM who INNER JOIN episode USING (doctor_no)
"""

QUERIES["rec_ward_header"] = "SELECT ward_name, specialty_name, number_of_care_units FROM ward"

_NURSES = """
SELECT staff_no, name, ward_name, care_unit_no, coalesce(title, '{without}') AS role
FROM nurse LEFT OUTER JOIN role_of USING (staff_no)
"""
QUERIES["rec_ward_nurses"] = _NURSES.format(without="Nurse")

QUERIES["rec_ward_patients"] = """
, treating AS (
  SELECT patient_no, (SELECT doctor_name FROM who WHERE doctor_no = doctor_staff_no) AS consultant_name FROM ptr)
SELECT ward_name, patient_no, patient_name, care_unit_no, bed_no, date_admitted, consultant_name
FROM (SELECT * FROM patient INNER JOIN care_unit USING (care_unit_no)) LEFT OUTER JOIN treating USING (patient_no)
"""

QUERIES["rec_doctor_header"] = """
SELECT doctor_no AS staff_no, doctor_name AS name, rank_held AS position, date_joined_team,
       field AS specialty_name, is_consultant
FROM who
"""

QUERIES["rec_doctor_experience"] = """
SELECT staff_no, exp_id, from_date, to_date, establishment, position
FROM previous_experience WHERE staff_no IN (SELECT doctor_no FROM who)
"""

QUERIES["rec_doctor_progress"] = """
SELECT staff_no, progress_id, establishment, position, date, performance_grade
FROM progress WHERE staff_no IN (SELECT doctor_no FROM who)
"""

QUERIES["rec_team_latest_grade"] = """
, newest AS (
  SELECT staff_no, performance_grade AS latest_grade FROM progress
  QUALIFY row_number() OVER (PARTITION BY staff_no ORDER BY date DESC NULLS LAST, progress_id DESC) = 1),
member AS (
  SELECT leader_no AS consultant_no, doctor_no AS staff_no, doctor_name AS name, rank_held AS position,
         date_joined_team, field AS specialty_name
  FROM who WHERE doctor_no <> leader_no
    AND leader_no IN (SELECT doctor_no FROM who WHERE is_consultant = 'Yes'))
SELECT member.*, latest_grade FROM member LEFT OUTER JOIN newest USING (staff_no)
"""

# --- dashboard, listings, lookups ------------------------------------------

QUERIES["dash_totals"] = """
SELECT unnest(['Patients', 'Doctors', 'Nurses', 'Wards', 'Beds', 'Specialties']) AS label,
       unnest([(SELECT count(*) FROM patient), (SELECT count(*) FROM doctor), (SELECT count(*) FROM nurse),
               (SELECT count(*) FROM ward), (SELECT count(*) FROM bed), (SELECT count(*) FROM specialty)]) AS n
"""

QUERIES["dash_recent_admissions"] = """
SELECT patient_no, patient_name, date_admitted FROM patient
QUALIFY row_number() OVER (ORDER BY date_admitted DESC NULLS LAST, patient_no) <= 5
"""

QUERIES["dash_specialty_overview"] = """
, tally AS (
  SELECT specialty_name, 1 AS is_ward FROM ward UNION ALL SELECT specialty_name, 0 FROM doctor)
SELECT specialty_name, count(*) FILTER (is_ward = 1) AS wards, count(*) FILTER (is_ward = 0) AS doctors
FROM specialty LEFT OUTER JOIN tally USING (specialty_name) GROUP BY specialty_name
"""

QUERIES["list_specialties"] = "FROM specialty"

QUERIES["list_ward_units"] = """
SELECT ward_name, specialty_name, number_of_care_units, count(care_unit_no) AS actual_care_units
FROM ward LEFT OUTER JOIN care_unit USING (ward_name) GROUP BY ALL
"""

QUERIES["list_unit_beds"] = """
SELECT care_unit_no, ward_name, count(bed_no) AS total_beds,
       count(bed_no) FILTER (is_occupied = 0) AS available_beds
FROM care_unit LEFT OUTER JOIN bed USING (care_unit_no) GROUP BY ALL
"""

QUERIES["list_beds"] = """
SELECT bed_no, care_unit_no, ward_name, if(is_occupied = 1, 'Occupied', 'Available') AS status
FROM care_unit INNER JOIN bed USING (care_unit_no)
"""

QUERIES["list_patients"] = """
SELECT patient_no, patient_name, date_of_birth, date_admitted, ward_name, care_unit_no, bed_no
FROM care_unit INNER JOIN patient USING (care_unit_no)
"""

QUERIES["list_doctors"] = """
SELECT own.doctor_no AS staff_no, own.doctor_name AS name, own.rank_held AS position,
       own.field AS specialty_name, own.date_joined_team, own.is_consultant,
       lead.doctor_name AS under_consultant
FROM who AS own LEFT OUTER JOIN who AS lead ON lead.doctor_no = own.leader_no
"""

QUERIES["list_nurses"] = _NURSES.format(without="Unassigned")

QUERIES["lk_wards"] = "SELECT ward_name, number_of_care_units FROM ward"
QUERIES["lk_consultants"] = """
SELECT doctor_no AS staff_no, doctor_name AS name FROM who WHERE rank_held = 'consultant'
"""
QUERIES["lk_patients"] = "SELECT patient_no, patient_name FROM patient"
QUERIES["lk_complaints"] = """
SELECT complaint_code, description, concat(complaint_code, ' - ', description[:40], '...') AS label
FROM complaint
"""
QUERIES["lk_care_units"] = """
SELECT care_unit_no, ward_name, concat(care_unit_no, ' (', ward_name, ')') AS label FROM care_unit
"""
QUERIES["lk_doctors"] = """
SELECT doctor_no AS staff_no, doctor_name AS name, concat(doctor_no, ' - ', doctor_name) AS label FROM who
"""
QUERIES["units_by_ward"] = "SELECT ward_name, care_unit_no FROM care_unit"
QUERIES["free_beds_by_unit"] = "SELECT care_unit_no, bed_no FROM bed WHERE is_occupied = 0"

# --- one key, a table of keys, JSON and date text --------------------------

_KEYED = {
    "q9_doctor_performance": "staff_no = 'DOC-007'",
    "q10_patient_full": "patient_no = 'PAT-011'",
    "rec_patient_header": "patient_no = 'PAT-011'",
    "rec_patient_history": "patient_no = 'PAT-011'",
    "rec_ward_header": "ward_name = 'WARD_7'",
    "rec_ward_nurses": "ward_name = 'WARD_7'",
    "rec_ward_patients": "ward_name = 'WARD_7'",
    "rec_doctor_header": "staff_no = 'DOC-007'",
    "rec_doctor_experience": "staff_no = 'DOC-007'",
    "rec_doctor_progress": "staff_no = 'DOC-007'",
    "rec_team_latest_grade": "consultant_no = 'DOC-006'",
}


def _where(name: str, condition: str) -> str:
    """The query's rows that satisfy ``condition``; its own lookups stay in front."""
    text = QUERIES[name].strip()
    at = text.rfind("\nSELECT") if text.startswith(",") else 0
    return f"{text[:at]}\nSELECT * FROM ({text[at:]}) AS answer WHERE {condition}"


for _name, _condition in _KEYED.items():
    QUERIES[f"{_name}_one"] = _where(_name, _condition)
QUERIES["q9_doctor_performance_of_registrars"] = _where(
    "q9_doctor_performance", "current_position = 'registrar(r)'")
QUERIES["q10_patient_full_of_ward"] = _where("q10_patient_full", "ward_name = 'WARD_7'")
QUERIES["units_by_ward_json"] = """
SELECT ward_name, json_object('ward_name', ward_name, 'care_unit_no', care_unit_no)::VARCHAR AS json
FROM care_unit
"""
QUERIES["free_beds_by_unit_json"] = """
SELECT care_unit_no, json_object('care_unit_no', care_unit_no, 'bed_no', bed_no)::VARCHAR AS json
FROM bed WHERE is_occupied = 0
"""
QUERIES["list_patients_text"] = """
SELECT patient_no, patient_name, strftime(date_of_birth, '%Y-%m-%d') AS date_of_birth,
       strftime(date_admitted, '%Y-%m-%d') AS date_admitted, ward_name, care_unit_no, bed_no
FROM care_unit INNER JOIN patient USING (care_unit_no)
"""


# --- ingestion scenarios ----------------------------------------------------
# Candidate batches follow wardline.sources.batches (input generation); the
# classification ranks the valid rows of a key: only the first one can be
# accepted, and only if the target lacks the key.

_TRIM = "' ' || chr(9) || chr(10) || chr(13) || chr(11)"
_BLANK = "' ' || chr(9) || ' '"


def _tr(expr: str) -> str:
    return f"trim({expr}, {_TRIM})"


def _batch_sql(src: str, k: str, key: str, fields: dict[str, str], blank_field: str,
               dup_field: str | None) -> str:
    padded = f"CASE WHEN {k} % 3 = 0 THEN ' ' || {fields[key]} || chr(9) ELSE {fields[key]} END"

    def rows(cond: str, seq: str, over: dict[str, str]) -> str:
        cols = {**fields, key: padded, **over}
        sel = ", ".join(f"{v} AS {n}" for n, v in cols.items())
        return (f"SELECT CAST({seq} AS BIGINT) AS arrival_seq, {sel} FROM {src} "
                f"WHERE {k} % 10 >= 7 AND {cond}")

    late = {} if dup_field is None else {dup_field: f"{fields[dup_field]} || ' II'"}
    return " UNION ALL ".join([
        rows("TRUE", f"{k} * 3 + 1", {}),
        rows(f"{k} % 10 = 9", f"{k} * 3", {blank_field: _BLANK}),
        rows(f"{k} % 10 = 8", f"{k} * 3 + 2", late),
        rows(f"{k} % 30 = 29", f"{k} * 3 + 1", {}),
        rows(f"{k} % 30 = 19", f"{k} * 3 + 1", late),
        rows(f"{k} % 20 = 9", "NULL", {}),
    ])


def _date_text(d: str, blank_when: str, bad_when: str) -> str:
    return (f"CASE WHEN {bad_when} THEN '1990-13-45' WHEN {blank_when} THEN '' "
            f"ELSE strftime({d}, '%Y-%m-%d') END")


def _opt_date(col: str) -> str:
    return (f"CASE WHEN {col} IS NULL OR {_tr(col)} = '' THEN NULL "
            f"ELSE CAST(try_strptime({_tr(col)}, '%Y-%m-%d') AS DATE) END")


def _bad_date(col: str) -> str:
    return (f"COALESCE({_tr(col)} <> '' AND try_strptime({_tr(col)}, '%Y-%m-%d') IS NULL, FALSE)")


def _same(key: str) -> str:
    """Equal for keys that differ in letter case and trailing spaces alone."""
    return f"lower(rtrim({key}, ' '))"


def _classify_sql(name: str, cleaned: str, target: str, key: str, required: list[str],
                  bad: str, out_cols: list[str], same=str) -> str:
    missing = " OR ".join(f"{c} IS NULL OR {c} = ''" for c in required)
    order = ", ".join(f"{c} NULLS FIRST" for c in out_cols)
    return f""",
{name}_clean AS ({cleaned}),
{name}_flag AS (SELECT *, ({missing}) AS missing, {bad} AS bad FROM {name}_clean),
{name}_turn AS (
  SELECT *, NOT missing AND NOT bad AND arrival_seq IS NOT NULL AS valid,
    row_number() OVER (PARTITION BY {same(key)}, NOT missing AND NOT bad AND arrival_seq IS NOT NULL
                       ORDER BY {order}) AS turn
  FROM {name}_flag),
{name}_outcome AS (
  SELECT {", ".join(out_cols)},
    CASE WHEN missing THEN 'missing_required'
         WHEN arrival_seq IS NULL THEN 'missing_sequence'
         WHEN bad THEN 'invalid_value'
         WHEN turn > 1 OR {same(key)} IN (SELECT {same(key)} FROM {target}) THEN 'duplicate_key'
         ELSE 'accepted' END AS outcome
  FROM {name}_turn)
"""


def _target_sql(table: str, key: str, prefix: str | None) -> str:
    num = (f"TRY_CAST(regexp_extract({key}, '(\\d+)$', 1) AS BIGINT)" if prefix is None
           else f"TRY_CAST(substring({key}, {len(prefix) + 2}, 99) AS BIGINT)")
    return f"t_{table} AS (SELECT * FROM {table} WHERE {num} % 10 < 8)"


_UNIT = "'CU-' || CAST(c_nationkey AS VARCHAR) || '-' || c_mktsegment"
_POSITION = ("CASE s_suppkey % 6 WHEN 0 THEN 'consultant' WHEN 1 THEN 'registrar(r)' "
             "WHEN 2 THEN 'assistant registrar(ar)' WHEN 3 THEN 'senior houseman(sh)' "
             "WHEN 4 THEN 'junior houseman(jh)' ELSE 'student(s)' END")

INGEST = ",\n".join([
    "t_specialty AS (SELECT * FROM specialty WHERE specialty_name IN "
    "(SELECT n_name FROM nation WHERE n_nationkey % 10 < 8))",
    _target_sql("ward", "ward_name", None),
    _target_sql("bed", "bed_no", "BED"),
    _target_sql("patient", "patient_no", "PAT"),
    _target_sql("doctor", "staff_no", "DOC"),
    _target_sql("consultant", "staff_no", "DOC"),
    _target_sql("nurse", "staff_no", "NUR"),
    _target_sql("day_sister", "staff_no", "NUR"),
    _target_sql("night_sister", "staff_no", "NUR"),
    _target_sql("staff_nurse", "staff_no", "NUR"),
    _target_sql("non_reg_nurse", "staff_no", "NUR"),
    "c_specialty AS (" + _batch_sql("nation", "n_nationkey", "specialty_name",
                                    {"specialty_name": "n_name"}, "specialty_name", None) + ")",
    "c_ward AS (" + _batch_sql("nation", "n_nationkey", "ward_name", {
        "ward_name": "'WARD_' || CAST(n_nationkey AS VARCHAR)",
        "specialty_name": "n_name",
        "num_care_units": "CASE WHEN n_nationkey % 25 = 18 THEN '99999999999' ELSE CASE n_nationkey % 4 WHEN 0 THEN NULL WHEN 1 THEN ' 3' "
                          "WHEN 2 THEN '4 units' ELSE 'x' END END"},
        "specialty_name", "specialty_name") + ")",
    "c_bed AS (" + _batch_sql("customer", "c_custkey", "bed_no", {
        "bed_no": "printf('BED-%03d', c_custkey)", "care_unit_no": _UNIT},
        "care_unit_no", None) + ")",
    "c_patient AS (" + _batch_sql("customer", "c_custkey", "patient_no", {
        "patient_no": "printf('PAT-%03d', c_custkey)",
        "patient_name": "c_name",
        "dob": _date_text("DATE '1940-01-01' + CAST((c_custkey * 37) % 20000 AS INTEGER)",
                          "c_custkey % 4 = 0", "c_custkey % 10 = 9 AND c_custkey % 7 = 0"),
        "date_admitted": _date_text("DATE '2020-01-01' + CAST(c_custkey % 365 AS INTEGER)",
                                    "c_custkey % 5 = 0", "FALSE"),
        "care_unit_no": _UNIT,
        "bed_no": "printf('BED-%03d', c_custkey)"}, "patient_name", "patient_name") + ")",
    "c_doctor AS (" + _batch_sql("supplier", "s_suppkey", "staff_no", {
        "staff_no": "printf('DOC-%03d', s_suppkey)",
        "name": "s_name",
        "position": f"CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE {_POSITION} END",
        "date_joined": _date_text("DATE '2010-01-01' + CAST(7 * s_suppkey AS INTEGER)",
                                  "s_suppkey % 4 = 0", "s_suppkey % 10 = 9 AND s_suppkey % 7 = 0"),
        "specialty_name": "'NATION_' || CAST(s_nationkey AS VARCHAR)",
        "consultant_staff_no": "CASE WHEN s_suppkey % 3 = 0 THEN '' "
                               "ELSE printf('DOC-%03d', s_suppkey - s_suppkey % 6) END",
        "is_consultant": "s_suppkey % 6 = 0"}, "name", "name") + ")",
    "c_nurse AS (" + _batch_sql("part", "p_partkey", "staff_no", {
        "staff_no": "printf('NUR-%03d', p_partkey)",
        "name": "p_name",
        "ward_name": "'WARD_' || CAST(p_partkey % 25 AS VARCHAR)",
        "care_unit_no": "'CU-' || CAST(p_partkey % 25 AS VARCHAR) || '-' || "
                        "(['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'])[p_size % 5 + 1]",
        "role": "CASE p_type WHEN 'ECONOMY' THEN 'day_sister' WHEN 'LARGE' THEN 'night_sister' "
                "WHEN 'MEDIUM' THEN 'staff_nurse' WHEN 'PROMO' THEN 'staff_nurse' "
                "WHEN 'SMALL' THEN 'non_reg' ELSE 'matron' END"},
        "role", "name") + ")",
])

_SPEC = _classify_sql(
    "specialty", f"SELECT arrival_seq, {_tr('specialty_name')} AS specialty_name FROM c_specialty",
    "t_specialty", "specialty_name", ["specialty_name"], "FALSE", ["arrival_seq", "specialty_name"])
_NUM = "'^\\s*([+-]?([0-9]+(\\.[0-9]*)?|\\.[0-9]+)([eE][+-]?[0-9]+)?)'"
_WARD = _classify_sql(
    "ward", f"""SELECT arrival_seq, {_tr('ward_name')} AS ward_name,
       {_tr('specialty_name')} AS specialty_name,
       CASE WHEN num_care_units IS NULL THEN 2
            WHEN regexp_extract(num_care_units, {_NUM}, 1) = '' THEN 0
            ELSE TRY_CAST(trunc(TRY_CAST(regexp_extract(num_care_units, {_NUM}, 1) AS DOUBLE))
                          AS INTEGER)
       END AS number_of_care_units FROM c_ward""",
    "t_ward", "ward_name", ["ward_name", "specialty_name"], "number_of_care_units IS NULL",
    ["arrival_seq", "ward_name", "specialty_name", "number_of_care_units"])
_BED = _classify_sql(
    "bed", f"SELECT arrival_seq, {_tr('bed_no')} AS bed_no, {_tr('care_unit_no')} AS care_unit_no,"
           " 0 AS is_occupied FROM c_bed",
    "t_bed", "bed_no", ["bed_no", "care_unit_no"], "FALSE",
    ["arrival_seq", "bed_no", "care_unit_no", "is_occupied"])
_PAT = _classify_sql(
    "patient", f"""SELECT arrival_seq, {_tr('patient_no')} AS patient_no,
       {_tr('patient_name')} AS patient_name, {_opt_date('dob')} AS date_of_birth,
       {_opt_date('date_admitted')} AS date_admitted, {_tr('care_unit_no')} AS care_unit_no,
       {_tr('bed_no')} AS bed_no, ({_bad_date('dob')} OR {_bad_date('date_admitted')}) AS is_bad
       FROM c_patient""",
    "t_patient", "patient_no", ["patient_no", "patient_name", "care_unit_no", "bed_no"], "is_bad",
    ["arrival_seq", "patient_no", "patient_name", "date_of_birth", "date_admitted",
     "care_unit_no", "bed_no"])
_DOC = _classify_sql(
    "doctor", f"""SELECT arrival_seq, {_tr('staff_no')} AS staff_no, {_tr('name')} AS name,
       CASE WHEN is_consultant THEN 'consultant' ELSE COALESCE({_tr('position')}, '') END AS position,
       {_opt_date('date_joined')} AS date_joined_team, {_tr('specialty_name')} AS specialty_name,
       NULLIF({_tr('consultant_staff_no')}, '') AS consultant_staff_no,
       COALESCE(is_consultant, FALSE) AS is_consultant, {_bad_date('date_joined')} AS is_bad
       FROM c_doctor""",
    "t_doctor", "staff_no", ["staff_no", "name", "specialty_name"], "is_bad",
    ["arrival_seq", "staff_no", "name", "position", "date_joined_team", "specialty_name",
     "consultant_staff_no", "is_consultant"])
_NUR = _classify_sql(
    "nurse", f"""SELECT arrival_seq, {_tr('staff_no')} AS staff_no, {_tr('name')} AS name,
       {_tr('ward_name')} AS ward_name, {_tr('care_unit_no')} AS care_unit_no,
       {_tr('role')} AS role,
       CASE {_tr('role')} WHEN 'day_sister' THEN 'day_sister' WHEN 'night_sister' THEN 'night_sister'
            WHEN 'staff_nurse' THEN 'staff_nurse' WHEN 'non_reg' THEN 'non_reg_nurse' END AS role_table
       FROM c_nurse""",
    "t_nurse", "staff_no", ["staff_no", "name", "ward_name", "care_unit_no", "role"], "FALSE",
    ["arrival_seq", "staff_no", "name", "ward_name", "care_unit_no", "role", "role_table"])

_INGEST_PREFIX = MAPPING + ",\n" + INGEST

QUERIES["ingest_specialty"] = _INGEST_PREFIX + _SPEC + "SELECT * FROM specialty_outcome"
QUERIES["ingest_ward"] = _INGEST_PREFIX + _WARD + "SELECT * FROM ward_outcome"
QUERIES["ingest_bed"] = _INGEST_PREFIX + _BED + "SELECT * FROM bed_outcome"
QUERIES["ingest_patient"] = _INGEST_PREFIX + _PAT + "SELECT * FROM patient_outcome"
QUERIES["ingest_doctor"] = _INGEST_PREFIX + _DOC + "SELECT * FROM doctor_outcome"
QUERIES["ingest_nurse"] = _INGEST_PREFIX + _NUR + "SELECT * FROM nurse_outcome"
QUERIES["bed_occupancy_update"] = _INGEST_PREFIX + _PAT + """
SELECT b.bed_no, b.care_unit_no,
       CASE WHEN b.bed_no IN (SELECT bed_no FROM patient_outcome WHERE outcome = 'accepted')
            THEN 1 ELSE b.is_occupied END AS is_occupied
FROM bed b
"""
QUERIES["ingest_doctor_consultants"] = _INGEST_PREFIX + _DOC + """
SELECT staff_no FROM t_consultant
UNION ALL
SELECT staff_no FROM doctor_outcome
WHERE outcome = 'accepted' AND is_consultant
  AND staff_no NOT IN (SELECT staff_no FROM t_consultant)
"""
QUERIES["ingest_nurse_roles"] = _INGEST_PREFIX + _NUR + " UNION ALL ".join(
    f"""
SELECT '{r}' AS role_table, staff_no FROM t_{r}
UNION ALL
SELECT '{r}' AS role_table, staff_no FROM nurse_outcome
WHERE outcome = 'accepted' AND role_table = '{r}' AND staff_no NOT IN (SELECT staff_no FROM t_{r})
""" for r in ("day_sister", "night_sister", "staff_nurse", "non_reg_nurse"))
QUERIES["assign_ids"] = _INGEST_PREFIX + """
SELECT c_custkey AS arrival_seq, c_name AS patient_name,
       printf('PAT-%03d', (SELECT COALESCE(MAX(TRY_CAST(substring(patient_no, 5, 99) AS BIGINT)), 0)
                           FROM t_patient) + row_number() OVER (ORDER BY c_custkey)) AS patient_no
FROM customer WHERE c_custkey % 10 >= 8
"""
QUERIES["next_ids"] = MAPPING + """
SELECT 'PATIENT' AS table_name,
       printf('PAT-%03d', COALESCE(MAX(TRY_CAST(substring(patient_no, 5, 99) AS BIGINT)), 0) + 1)
         AS next_id FROM patient
UNION ALL
SELECT 'DOCTOR', printf('DOC-%03d', COALESCE(MAX(TRY_CAST(substring(staff_no, 5, 99) AS BIGINT)), 0) + 1)
FROM doctor
UNION ALL
SELECT 'NURSE', printf('NUR-%03d', COALESCE(MAX(TRY_CAST(substring(staff_no, 5, 99) AS BIGINT)), 0) + 1)
FROM nurse
UNION ALL
SELECT 'BED', printf('BED-%03d', COALESCE(MAX(TRY_CAST(substring(bed_no, 5, 99) AS BIGINT)), 0) + 1)
FROM bed
"""


# Jobs that store their tables in another layout give the rows of the plain ones.
for _copy, _of in {
        "dash_totals_counted": "dash_totals", "q7_multi_complaint_bucketed": "q7_multi_complaint",
        "q10_patient_full_catalog": "q10_patient_full", "q9_doctor_performance_sql": "q9_doctor_performance_one",
        "q11_complaint_daterange_monthly": "q11_complaint_daterange",
        "q11_complaint_daterange_sql": "q11_complaint_daterange",
        "bed_occupancy_partitioned": "bed_occupancy_update"}.items():
    QUERIES[_copy] = QUERIES[_of]

QUERIES["team_activity_sql"] = f"""
SELECT doctor_no AS staff_no, doctor_name AS name,
       (SELECT count(*) FROM ptr WHERE doctor_staff_no = doctor_no
          AND date_started >= DATE '{Q11_PARAMS["date_from"]}'
          AND date_started <= DATE '{Q11_PARAMS["date_to"]}') AS n_treatments
FROM who WHERE leader_no = 'DOC-006' AND doctor_no <> 'DOC-006'
"""

QUERIES["ingest_outcome_counts"] = _INGEST_PREFIX + "".join((_SPEC, _WARD, _BED, _PAT, _DOC, _NUR)) + (
    " UNION ALL ".join(f"SELECT '{e}' AS entity, outcome, count(*) AS n FROM {e}_outcome GROUP BY outcome"
                       for e in ("specialty", "ward", "bed", "patient", "doctor", "nurse")))


def _respelled(key: str, number: str) -> str:
    return f"CASE ({number}) % 3 WHEN 1 THEN lower({key}) WHEN 2 THEN {key} || ' ' ELSE {key} END"


_DOCTOR_COLLATED = _classify_sql(
    "doctor", f"""SELECT arrival_seq, {_tr(_respelled('staff_no', 'arrival_seq'))} AS staff_no, {_tr('name')} AS name,
       CASE WHEN is_consultant THEN 'consultant' ELSE COALESCE({_tr('position')}, '') END AS position,
       {_opt_date('date_joined')} AS date_joined_team, {_tr('specialty_name')} AS specialty_name,
       NULLIF({_tr('consultant_staff_no')}, '') AS consultant_staff_no,
       COALESCE(is_consultant, FALSE) AS is_consultant, {_bad_date('date_joined')} AS is_bad
       FROM c_doctor""",
    "s_doctor", "staff_no", ["staff_no", "name", "specialty_name"], "is_bad",
    ["arrival_seq", "staff_no", "name", "position", "date_joined_team", "specialty_name",
     "consultant_staff_no", "is_consultant"], _same)
QUERIES["ingest_doctor_collated"] = _INGEST_PREFIX + f""",
s_doctor AS (
  SELECT {_respelled('staff_no', "TRY_CAST(substring(staff_no, 5, 99) AS BIGINT)")} AS staff_no FROM t_doctor)
""" + _DOCTOR_COLLATED + "SELECT * FROM doctor_outcome"

_MIXED = f""",
m_ptr AS (SELECT * REPLACE ({_respelled('patient_no', 'day(date_started)')} AS patient_no) FROM ptr),
m_progress AS (SELECT * REPLACE ({_respelled('staff_no', 'progress_id')} AS staff_no) FROM progress)
"""
QUERIES["q3_patient_treatments_collated"] = _MIXED + f"""
SELECT f.patient_no, p.patient_name, f.complaint_code, c.description AS complaint, f.treatment_code,
       t.description AS treatment, d.name AS doctor_name, f.date_started, f.date_ended
FROM m_ptr f, patient p, complaint c, treatment t, doctor d
WHERE {_same('f.patient_no')} = {_same('p.patient_no')} AND f.complaint_code = c.complaint_code
  AND f.treatment_code = t.treatment_code AND f.doctor_staff_no = d.staff_no
"""
QUERIES["q9_doctor_performance_collated"] = _MIXED + f"""
SELECT doctor_no AS staff_no, doctor_name, rank_held AS current_position, field AS specialty_name,
       p.establishment, p.position AS role_at_establishment, p.date, p.performance_grade
FROM m_progress p, who WHERE {_same('p.staff_no')} = {_same('doctor_no')}
"""

_PAT_K = "TRY_CAST(substring(patient_no, 5, 99) AS BIGINT)"
_FAULTS = _MIXED + f""",
more AS (
  SELECT * FROM patient UNION ALL
  SELECT * FROM patient WHERE {_PAT_K} % 50 = 3 UNION ALL
  SELECT * REPLACE (lower(patient_no) AS patient_no) FROM patient WHERE {_PAT_K} % 50 = 7 UNION ALL
  SELECT * REPLACE (CAST(NULL AS VARCHAR) AS patient_no) FROM patient WHERE {_PAT_K} % 50 = 11),
f_patient AS (
  SELECT * REPLACE (CASE WHEN {_PAT_K} % 20 = 9 THEN NULL
                         WHEN {_PAT_K} % 20 = 13 THEN printf('BED-%03d', {_PAT_K} - 1)
                         ELSE bed_no END AS bed_no) FROM more),
f_bed AS (
  SELECT * REPLACE (CASE WHEN TRY_CAST(substring(bed_no, 5, 99) AS BIGINT) % 40 = 5 THEN 'CU-?'
                         ELSE care_unit_no END AS care_unit_no) FROM bed),
f_nurse AS (
  SELECT * REPLACE (CASE WHEN TRY_CAST(substring(staff_no, 5, 99) AS BIGINT) % 30 = 4 THEN 'WARD_0'
                         ELSE ward_name END AS ward_name) FROM nurse),
f_ptr AS (
  SELECT * REPLACE (CASE day(date_started) WHEN 13 THEN 'DOC-X' || right(treatment_code, 1)
                         WHEN 28 THEN NULL ELSE doctor_staff_no END AS doctor_staff_no) FROM m_ptr)
"""


def _audit_sql(at: dict[str, str], same=str) -> str:
    """One SELECT per rule; ``at`` names the relations that stand for tables."""

    def rows(table: str, column: str, rule: str, values: str, keys: str = "count(DISTINCT k)",
             n: str = "count(k)", example: str = "min(k)") -> str:
        return (f"SELECT '{table}' AS table_name, '{column}' AS column_name, '{rule}' AS rule,"
                f" CAST(coalesce({n}, 0) AS BIGINT) AS n_rows, CAST({keys} AS BIGINT) AS n_keys,"
                f" {example} AS example_key FROM ({values})")

    def value(column: str) -> str:
        return same(f"CAST({column} AS VARCHAR)")

    parts = []
    for table, key in KEYS.items():
        name = at.get(table, table)
        parts.append(rows(table, key, "duplicate_key", f"SELECT {value(key)} AS k, count(*) AS n FROM {name}"
                          f" WHERE {key} IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
                          keys="count(*)", n="sum(n) - count(*)"))
        parts.append(rows(table, key, "null_key", f"SELECT 1 AS k FROM {name} WHERE {key} IS NULL",
                          keys="0", example="CAST(NULL AS VARCHAR)"))
    for table, column, parent in REFERENCES:
        name, other = at.get(table, table), at.get(parent, parent)
        parts.append(rows(table, column, "orphan", f"SELECT {value('c.' + column)} AS k FROM {name} c"
                          f" WHERE c.{column} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {other} o"
                          f" WHERE {value('o.' + KEYS[parent])} = {value('c.' + column)})"))
        if (table, column) not in OPTIONAL_REFERENCES:
            parts.append(rows(table, column, "null_reference", f"SELECT 1 AS k FROM {name}"
                              f" WHERE {column} IS NULL", keys="0", example="CAST(NULL AS VARCHAR)"))
    nurse, unit, patient, bed = (at.get(x, x) for x in ("nurse", "care_unit", "patient", "bed"))
    parts.append(rows("nurse", "care_unit_no", "unit_of_other_ward",
                      f"SELECT {value('n.care_unit_no')} AS k FROM {nurse} n JOIN {unit} u"
                      f" ON {value('u.care_unit_no')} = {value('n.care_unit_no')}"
                      f" WHERE {value('u.ward_name')} <> {value('n.ward_name')}"))
    parts.append(rows("patient", "bed_no", "bed_of_other_unit",
                      f"SELECT {value('p.bed_no')} AS k FROM {patient} p JOIN {bed} b"
                      f" ON {value('b.bed_no')} = {value('p.bed_no')}"
                      f" WHERE {value('b.care_unit_no')} <> {value('p.care_unit_no')}"))
    return "\nUNION ALL ".join(parts)


_FAULTY = {"patient": "f_patient", "bed": "f_bed", "nurse": "f_nurse", "ptr": "f_ptr", "progress": "m_progress"}
QUERIES["audit_integrity"] = _audit_sql({})
QUERIES["audit_integrity_faults"] = _FAULTS + _audit_sql(_FAULTY)
QUERIES["audit_integrity_collated"] = _FAULTS + _audit_sql(_FAULTY, _same)


_FULL = {name for name in QUERIES if name.startswith(("ingest_", "bed_occupancy", "assign_ids",
                                                       "next_ids"))}


def oracle_sql() -> dict[str, str]:
    return {name: (sql if name in _FULL else MAPPING + sql) for name, sql in QUERIES.items()}
