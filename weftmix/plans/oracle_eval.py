"""Oracle SQL (DuckDB) for the evaluation queries."""

from __future__ import annotations

from weftmix.plans import evaluation as E
from weftmix.plans import inputs
from weftmix.plans.sqlparts import h, sql_str, strip

NL = "chr(10)"
# The score rules of the survey, written for DuckDB on their own: a plain
# decimal number, and a tuple or list of two of them.
NUMBER = "[-+]?(?:\\d+(?:\\.\\d*)?|\\.\\d+)(?:[eE][-+]?\\d+)?"
PAIR = f"^\\s*[(\\[]?\\s*({NUMBER})\\s*,\\s*({NUMBER})\\s*,?\\s*[)\\]]?\\s*$"


def _cats() -> str:
    return "[" + ", ".join(sql_str(c) for c in inputs.CATEGORIES) + "]"


QUESTIONS = f"""questions AS (
  SELECT doc_id + 1 AS question_id, text,
         {_cats()}[CAST(regexp_extract(source, '(\\d+)', 1) AS INTEGER) % {len(inputs.CATEGORIES)} + 1] AS category
  FROM documents)"""


def _answers(name: str, half: int, model: str) -> str:
    txt = ("substring(text, 1, CAST(floor(length(text) / 2) AS INTEGER))" if half == 1
           else "substring(text, CAST(floor(length(text) / 2) AS INTEGER) + 1)")
    return f"""{name} AS (
  SELECT doc_id + 1 AS question_id, {txt} AS text,
         substr(sha256(concat_ws(':', {sql_str(model)}, CAST(doc_id + 1 AS VARCHAR))), 1, 22) AS answer_id
  FROM documents)"""


def parse_sql(text: str, category: str) -> str:
    """H15 in SQL: returns a DOUBLE[2] expression."""
    t = strip(f"coalesce({text}, '')")
    first = f"string_split({t}, {NL})[1]"
    pieces = f"string_split(replace({first}, ',', ' '), ' ')"
    p1, p2 = strip(f"{pieces}[1]"), strip(f"{pieces}[2]")
    num = f"'^{NUMBER}$'"
    plain_ok = f"(len({pieces}) = 2 AND regexp_matches({p1}, {num}) AND regexp_matches({p2}, {num}))"
    tail = f"string_split(string_split({t}, {NL})[-1], ':')[-1]"
    mre = sql_str(PAIR)
    math_ok = f"regexp_matches({tail}, {mre})"
    m1, m2 = f"regexp_extract({tail}, {mre}, 1)", f"regexp_extract({tail}, {mre}, 2)"
    return f"""(CASE WHEN coalesce({category} = 'math', false) AND {math_ok}
       THEN [CAST({m1} AS DOUBLE), CAST({m2} AS DOUBLE)]
     WHEN NOT coalesce({category} = 'math', false) AND {plain_ok}
       THEN [CAST({p1} AS DOUBLE), CAST({p2} AS DOUBLE)]
     ELSE [-1.0, -1.0]::DOUBLE[] END)"""


def _config() -> str:
    rv = ", ".join(f"({i}, {pid}, {sql_str(cat)})" for i, (_, pid, cat) in enumerate(E.REVIEWER_ROWS))
    pr = ", ".join(f"({pid}, {sql_str(sp)}, {sql_str(tpl)}, {sql_str(d['prompt'])})"
                   for pid, sp, tpl, d in E.JUDGE_PROMPT_ROWS)
    return f"""reviewers AS (SELECT * FROM (VALUES {rv}) v(reviewer_idx, prompt_id, category)),
prompts AS (SELECT * FROM (VALUES {pr}) v(prompt_id, system_prompt, prompt_template, default_prompt))"""


def _fill() -> str:
    # double braces are set aside as control characters before fields are cut
    held = "replace(replace(prompt_template, '{{', chr(1)), '}}', chr(2))"
    tokens = f"regexp_extract_all({held}, '\\{{[^{{}}]*\\}}|[^{{}}]+')"
    name = "substr(tok, 2, length(tok) - 2)"
    val = (f"CASE {name} WHEN 'question' THEN question WHEN 'answer_1' THEN answer1 "
           f"WHEN 'answer_2' THEN answer2 WHEN 'prompt' THEN default_prompt END")
    return (f"array_to_string(list_transform({tokens}, lambda tok: CASE WHEN regexp_matches(tok, '^\\{{[^{{}}]*\\}}$') "
            f"THEN {val} ELSE replace(replace(tok, chr(1), '{{'), chr(2), '}}') END), '')")


def requests_cte(retry: bool = False, only_pending: str | None = None) -> str:
    mt = "2048" if retry else "CASE WHEN category = 'math' THEN 2048 ELSE 32 END"
    filt = f"WHERE q.question_id IN (SELECT question_id FROM {only_pending})" if only_pending else ""
    name = "req_retry" if retry else "req"
    return f"""{name} AS (
  SELECT j.*, {_fill()} AS prompt, {mt} AS max_tokens
  FROM (SELECT q.question_id, q.text AS question, q.category, a1.text AS answer1, a1.answer_id AS answer1_id,
               a2.text AS answer2, a2.answer_id AS answer2_id,
               coalesce(f.idx, 0) + 1 AS reviewer_id, r.prompt_id, p.system_prompt, p.prompt_template,
               p.default_prompt
        FROM questions q JOIN ans1 a1 USING (question_id) JOIN ans2 a2 USING (question_id)
        LEFT JOIN (SELECT category, min(reviewer_idx) AS idx FROM reviewers GROUP BY category) f
               ON f.category = q.category
        JOIN reviewers r ON r.reviewer_idx = coalesce(f.idx, 0)
        JOIN prompts p ON p.prompt_id = r.prompt_id
        {filt}) j)"""


def judge_sql(attempt: int) -> str:
    a = f"CAST({h(['prompt'], 'judge-a')} % 11 AS VARCHAR)"
    b = f"CAST({h(['prompt'], 'judge-b')} % 11 AS VARCHAR)"
    fmt = f"({h(['prompt'], f'judge-fmt-{attempt}')} % 6)" if attempt == 0 else "0"
    ex = sql_str(E.EXPLAIN)
    plain = f"""CASE WHEN {fmt} = 1 THEN {a} || ',' || {b} || {NL} || {ex}
          WHEN {fmt} = 2 THEN {a} || ', ' || {b} || {NL} || {ex}
          WHEN {fmt} = 3 THEN 'error'
          WHEN {fmt} = 4 THEN {a} || ' ' || {b} || ' ' || {NL} || {ex}
          WHEN {fmt} = 5 THEN '  ' || {a} || ' ' || {b} || chr(13) || {NL} || {ex}
          ELSE {a} || ' ' || {b} || {NL} || {ex} END"""
    work = f"'Working through both answers.' || {NL}"
    math = f"""CASE WHEN {fmt} = 2 THEN {work} || 'The output tuple is (' || {a} || ', ' || {b} || ').'
          WHEN {fmt} = 3 THEN 'error'
          WHEN {fmt} = 4 THEN {work} || 'Scores: [' || {a} || ',' || {b} || ']'
          ELSE {work} || 'Output: (' || {a} || ', ' || {b} || ')' END"""
    return f"(CASE WHEN category = 'math' THEN {math} ELSE {plain} END)"


def _reviews_cte(name: str, req: str, attempt: int) -> str:
    return f"""{name} AS (
  SELECT substr(sha256(concat_ws(':', CAST(question_id AS VARCHAR), answer1_id, answer2_id,
                                 CAST(reviewer_id AS VARCHAR))), 1, 22) AS review_id,
         question_id, answer1_id, answer2_id, reviewer_id, category, text, {parse_sql('text', 'category')} AS score
  FROM (SELECT *, {judge_sql(attempt)} AS text FROM {req}))"""


REVIEW_COLS = """SELECT review_id, CAST(question_id AS BIGINT) AS question_id, answer1_id, answer2_id,
       CAST(reviewer_id AS BIGINT) AS reviewer_id, text, score[1] AS score_a, score[2] AS score_b"""


def _base() -> str:
    return f"""WITH {QUESTIONS},
{_answers('ans1', 1, 'model-a')},
{_answers('ans2', 2, 'model-b')},
{_config()},
{requests_cte()},
{_reviews_cte('rev', 'req', 0)}"""


def _retry_ctes() -> str:
    return f""",
pending AS (SELECT * FROM rev WHERE score[1] < 0 OR score[2] < 0),
{requests_cte(retry=True, only_pending='pending')},
{_reviews_cte('rev_new', 'req_retry', 1)},
merged AS (
  SELECT o.review_id, o.question_id, o.answer1_id, o.answer2_id, o.reviewer_id, o.category,
         coalesce(n.text, o.text) AS text, CASE WHEN n.text IS NOT NULL THEN n.score ELSE o.score END AS score
  FROM rev o LEFT JOIN rev_new n USING (question_id))"""


def review_requests_sql() -> str:
    return f"""{_base()}
SELECT CAST(question_id AS BIGINT) AS question_id, category, CAST(reviewer_id AS BIGINT) AS reviewer_id,
       CAST(prompt_id AS BIGINT) AS prompt_id, CAST(max_tokens AS BIGINT) AS max_tokens, answer1_id, answer2_id,
       system_prompt, CAST(length(prompt) AS BIGINT) AS prompt_len, md5(prompt) AS prompt_md5
FROM req"""


def review_answers_sql() -> str:
    return f"{_base()}\n{REVIEW_COLS} FROM rev"


def pending_reviews_sql() -> str:
    return f"{_base()}\n{REVIEW_COLS} FROM rev WHERE score[1] < 0 OR score[2] < 0"


def merge_reviews_sql() -> str:
    return f"{_base()}{_retry_ctes()}\n{REVIEW_COLS} FROM merged"


def _category_rows(src: str) -> str:
    return f"""SELECT category, CAST(count(*) AS BIGINT) AS n_reviews, round(avg(score[1]), 2) AS score_a,
       round(avg(score[2]), 2) AS score_b, round(avg(score[1]), 6) AS mean_a, round(avg(score[2]), 6) AS mean_b,
       CAST((SELECT min(question_id) FROM questions q WHERE q.category = s.category) AS BIGINT) AS first_qid
FROM {src} s WHERE score[1] > 0 AND score[2] > 0 GROUP BY category"""


def review_scores_sql() -> str:
    return f"{_base()}{_retry_ctes()}\n{_category_rows('merged')}"


LABEL_REVIEWS = f"""lab AS (
  SELECT doc_id, CAST(1 + quality * 5 + {h(['doc_id'], 'label-a')} % 4 AS VARCHAR) AS a,
         CAST(1 + toxic * 5 + {h(['doc_id'], 'label-b')} % 4 AS VARCHAR) AS b,
         {h(['doc_id'], 'label-fmt')} % 5 AS v
  FROM labels),
label_rev AS (
  SELECT r.question_id, r.text, q.category, {parse_sql('r.text', 'q.category')} AS score
  FROM (SELECT doc_id + 1 AS question_id,
               CASE WHEN v = 1 THEN a || ',' || b || {NL} || 'Explanation.' || {NL} || 'Output: (' || a || ',' || b || ')'
                    WHEN v = 2 THEN a || ', ' || b || {NL} || 'Explanation.' || {NL} || 'The output tuple is (' || a || ', ' || b || ').'
                    WHEN v = 3 THEN a || ' ' || b || ' ' || {NL} || 'Explanation.' || {NL} || 'Output: (' || a || ', ' || b || ')'
                    WHEN v = 4 THEN 'error'
                    ELSE a || ' ' || b || {NL} || 'Explanation.' || {NL} || 'Output: (' || a || ', ' || b || ')' END AS text
        FROM lab) r JOIN questions q USING (question_id))"""


def category_scores_sql() -> str:
    return f"WITH {QUESTIONS},\n{LABEL_REVIEWS}\n{_category_rows('label_rev')}"


def micro_scores_sql() -> str:
    return f"""WITH {QUESTIONS},
{LABEL_REVIEWS}
SELECT CAST(count(*) AS BIGINT) AS n_reviews, round(avg(score[1]), 6) AS micro_a, round(avg(score[2]), 6) AS micro_b
FROM label_rev WHERE score[1] > 0 AND score[2] > 0"""


def macro_scores_sql() -> str:
    return f"""WITH {QUESTIONS},
{LABEL_REVIEWS},
cats AS (SELECT category, avg(score[1]) AS ma, avg(score[2]) AS mb FROM label_rev
         WHERE score[1] > 0 AND score[2] > 0 GROUP BY category)
SELECT CAST(count(*) AS BIGINT) AS n_categories, round(avg(ma), 6) AS macro_a, round(avg(mb), 6) AS macro_b
FROM cats"""


def score_table_sql() -> str:
    return f"""WITH {QUESTIONS},
{LABEL_REVIEWS},
ok AS (SELECT * FROM label_rev WHERE score[1] > 0 AND score[2] > 0),
cats AS (SELECT category, count(*) AS n, avg(score[1]) AS ma, avg(score[2]) AS mb,
                (SELECT min(question_id) FROM questions q WHERE q.category = ok.category) AS fq
         FROM ok GROUP BY category)
SELECT category, CAST(n AS BIGINT) AS n_reviews, round(ma, 6) AS mean_a, round(mb, 6) AS mean_b,
       CAST(fq AS BIGINT) AS first_qid FROM cats
UNION ALL SELECT 'micro', CAST(count(*) AS BIGINT), round(avg(score[1]), 6), round(avg(score[2]), 6),
       NULL FROM ok
UNION ALL SELECT 'macro', CAST(count(*) AS BIGINT), round(avg(ma), 6), round(avg(mb), 6), NULL FROM cats"""


def parse_scores_sql() -> str:
    return f"""WITH {QUESTIONS},
{LABEL_REVIEWS}
SELECT CAST(question_id AS BIGINT) AS question_id, category, text, score[1] AS score_a, score[2] AS score_b
FROM label_rev"""


def rejected_reviews_sql() -> str:
    """Label reviews plus one of a question that doesn't exist per label."""
    return f"""WITH {QUESTIONS},
{LABEL_REVIEWS}
SELECT CAST(question_id AS BIGINT) AS question_id, 'no two positive scores' AS reason
FROM label_rev WHERE NOT (score[1] > 0 AND score[2] > 0)
UNION ALL SELECT CAST(-question_id AS BIGINT), 'unknown question' FROM label_rev"""


def misaligned_answers_sql() -> str:
    return f"""WITH {QUESTIONS},
q AS (SELECT question_id FROM questions),
x1 AS (SELECT question_id FROM questions q JOIN documents d ON d.doc_id + 1 = q.question_id WHERE d.lang <> 'es'),
x2 AS (SELECT doc_id + 1 AS question_id FROM documents WHERE lang <> 'fr'
       UNION ALL SELECT doc_id + 1 FROM documents WHERE lang = 'de' UNION ALL SELECT -doc_id - 1 FROM documents WHERE lang = 'es'),
n AS (SELECT question_id, (SELECT count(*) FROM q WHERE q.question_id = i.question_id) AS nq,
             (SELECT count(*) FROM x1 WHERE x1.question_id = i.question_id) AS n1, (SELECT count(*) FROM x2 WHERE x2.question_id = i.question_id) AS n2
      FROM (SELECT question_id FROM q UNION SELECT question_id FROM x1 UNION SELECT question_id FROM x2) i)
SELECT CAST(question_id AS BIGINT) AS question_id, concat_ws(', ',
         CASE WHEN nq = 0 THEN 'no question' WHEN nq > 1 THEN 'repeated question' END,
         CASE WHEN n1 = 0 THEN 'no answer1' WHEN n1 > 1 THEN 'repeated answer1' END,
         CASE WHEN n2 = 0 THEN 'no answer2' WHEN n2 > 1 THEN 'repeated answer2' END) AS reason
FROM n WHERE NOT (nq = 1 AND n1 = 1 AND n2 = 1)"""


def contiguous_ids_sql() -> str:
    return f"""WITH {QUESTIONS}
SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(min(question_id) AS BIGINT) AS min_id,
       CAST(max(question_id) AS BIGINT) AS max_id, CAST(count(DISTINCT question_id) AS BIGINT) AS n_distinct,
       (min(question_id) = 1 AND max(question_id) = count(*) AND count(DISTINCT question_id) = count(*)) AS ok
FROM questions"""


def aligned_answers_sql() -> str:
    return f"""WITH {QUESTIONS},
{_answers('ans1', 1, 'model-a')},
{_answers('ans2', 2, 'model-b')},
j AS (SELECT q.question_id AS q, a1.question_id AS x1, a2.question_id AS x2
      FROM questions q FULL OUTER JOIN ans1 a1 ON q.question_id = a1.question_id
      FULL OUTER JOIN ans2 a2 ON coalesce(q.question_id, a1.question_id) = a2.question_id)
SELECT CAST(count(q) AS BIGINT) AS n_questions, CAST(count(x1) AS BIGINT) AS n_answers1,
       CAST(count(x2) AS BIGINT) AS n_answers2,
       CAST(sum(CASE WHEN q IS NOT NULL AND x1 IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS missing1,
       CAST(sum(CASE WHEN q IS NOT NULL AND x2 IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS missing2,
       CAST(sum(CASE WHEN q IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS extra,
       (count(q) = count(x1) AND count(q) = count(x2)
        AND sum(CASE WHEN (q IS NOT NULL AND (x1 IS NULL OR x2 IS NULL)) OR q IS NULL THEN 1 ELSE 0 END) = 0) AS ok
FROM j"""
