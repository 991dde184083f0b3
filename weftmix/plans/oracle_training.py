"""Oracle SQL (DuckDB) for the training-data queries."""

from __future__ import annotations

from weftmix.plans import inputs
from weftmix.plans.sqlparts import (cps, h, ids_md5, lm_split, mask_upto, pad, rstrip, sql_str,
                                    strip, values_pools)
from weftmix.plans.training import BATCH_SIZE, CORPUS_WEIGHTS, MAX_LEN, STAGE1_WEIGHTS, STAGE2_WEIGHTS, WORLD_SIZE


def _spec(weights) -> str:
    rows = ", ".join(f"({sql_str(t)}, {i}, {w})" for i, (t, w) in enumerate(weights))
    return f"""spec AS (
  SELECT tag, CAST(weight AS BIGINT) AS w,
         CAST(coalesce(sum(weight) OVER (ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS o,
         CAST(sum(weight) OVER () AS BIGINT) AS cyc
  FROM (VALUES {rows}) v(tag, ord, weight))"""


def _index(name: str, rows: str, order: str = "r.doc_id") -> str:
    """Shard files over ranks and number rows per (tag, rank)."""
    R = WORLD_SIZE
    return f"""{name}_files AS (
  SELECT tag, file_name, row_number() OVER (PARTITION BY tag ORDER BY file_name) - 1 AS file_ord
  FROM (SELECT DISTINCT tag, file_name FROM {rows})),
{name}_idx AS (
  SELECT r.*, f.file_ord % {R} AS rank,
         row_number() OVER (PARTITION BY r.tag, f.file_ord % {R} ORDER BY f.file_ord // {R}, {order}) - 1 AS row_idx,
         count(*) OVER (PARTITION BY r.tag, f.file_ord % {R}) AS n_rows
  FROM {rows} r JOIN {name}_files f ON r.tag = f.tag AND r.file_name = f.file_name)"""


def _steps(names, B=BATCH_SIZE) -> str:
    parts = " UNION ALL ".join(f"SELECT DISTINCT tag, rank, n_rows FROM {n}_idx" for n in names)
    return f"""steps AS (
  SELECT CAST(ceil(max(ceil(n_rows / w) * cyc) / {B}) AS BIGINT) AS s
  FROM ({parts}) x JOIN spec USING (tag))"""


def _draws(name: str, B=BATCH_SIZE, start_step: int = 0) -> str:
    """Closed-form schedule, written directly in SQL."""
    g_end = f"(st.s * {B})"
    g_start = f"(least({int(start_step)}, st.s) * {B})"
    k = lambda G: f"(({G} // sp.cyc) * sp.w + least(greatest({G} % sp.cyc - sp.o, 0), sp.w))"
    return f"""{name}_k AS (
  SELECT i.*, sp.w, sp.o, sp.cyc, CAST({k(g_start)} AS BIGINT) AS k_lo, CAST({k(g_end)} AS BIGINT) AS k_hi
  FROM {name}_idx i JOIN spec sp USING (tag) CROSS JOIN steps st),
{name}_k2 AS (
  SELECT *, CAST(CASE WHEN row_idx >= k_lo THEN row_idx
                 ELSE row_idx + CAST(ceil((k_lo - row_idx) / n_rows) AS BIGINT) * n_rows END AS BIGINT) AS k_first
  FROM {name}_k),
{name}_draws AS (
  SELECT *, (draw // w) * cyc + o + draw % w AS global_pos,
         ((draw // w) * cyc + o + draw % w) // {B} AS batch_id,
         ((draw // w) * cyc + o + draw % w) % {B} AS slot
  FROM (SELECT *, unnest(range(k_first, k_hi, n_rows)) AS draw FROM {name}_k2 WHERE k_first < k_hi))"""


def _report(src: str) -> str:
    return f"""SELECT CAST(rank AS BIGINT) AS rank, CAST(batch_id AS BIGINT) AS batch_id, CAST(slot AS BIGINT) AS slot,
       tag, CAST(doc_id AS BIGINT) AS doc_id, CAST(pad_len AS BIGINT) AS n_ids, CAST(pad_len AS BIGINT) AS pad_len,
       CAST(n_target AS BIGINT) AS n_target,
       {ids_md5(pad('ids', 'pad_len'))} AS ids_md5, {ids_md5(pad('mask', 'pad_len'))} AS mask_md5
FROM (SELECT *, max(len(ids)) OVER (PARTITION BY rank, batch_id) AS pad_len FROM {src})"""


def _lm_feats(name: str, L=MAX_LEN) -> str:
    key = ["rank", "global_pos"]
    return f"""{name}_f AS (
  SELECT rank, batch_id, slot, tag, doc_id, ids, {mask_upto('len(ids)', 'least(sp_pos, len(ids))')} AS mask,
         len(ids) - least(sp_pos, len(ids)) AS n_target
  FROM (SELECT *, {lm_split('len(ids)', key)} AS sp_pos
        FROM (SELECT *, list_slice(list_concat([1], {cps('text')}, [2]), 1, {L}) AS ids FROM {name}_draws)))"""


def _s2s_feats(name: str, prefix_sql: str, L=MAX_LEN) -> str:
    return f"""{name}_f AS (
  SELECT rank, batch_id, slot, tag, doc_id, list_slice(list_concat(ids1, ids2), 1, {L}) AS ids,
         {mask_upto(f'least(len(ids1) + len(ids2), {L})', 'len(ids1)')} AS mask,
         greatest(least(len(ids1) + len(ids2), {L}) - len(ids1), 0) AS n_target
  FROM (SELECT *, list_concat([1], {cps(prefix_sql)}) AS ids1, list_concat({cps('output')}, [2]) AS ids2
        FROM {name}_ex))"""


def _translate_examples(name: str, post: bool) -> str:
    key = ["rank", "global_pos"]
    return f"""{name}_ex AS (
  SELECT d.*, CASE WHEN dir = 'en-zh' THEN en_text ELSE zh_text END AS input,
         CASE WHEN dir = 'en-zh' THEN zh_text ELSE en_text END AS output,
         p.prompts[{h(key, 'translate-prompt')} % len(p.prompts) + 1] AS prompt
  FROM (SELECT *, ['en-zh', 'zh-en'][{h(key, 'direction')} % 2 + 1] AS dir FROM {name}_draws) d
  LEFT JOIN {values_pools(inputs.TRANSLATE_POOLS)} ON p.pool_key = d.dir)"""


def _docs_rows() -> str:
    return """lm_rows AS (SELECT lang AS tag, source AS file_name, doc_id, text FROM documents WHERE lang IN ('de', 'en', 'es')),
en_j AS (SELECT source, doc_id, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS j
         FROM documents WHERE lang = 'en'),
fr_j AS (SELECT source, doc_id, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS j
         FROM documents WHERE lang = 'fr'),
tr_rows AS (SELECT 'translate' AS tag, a.source AS file_name, a.doc_id, b.doc_id AS pair_doc_id,
                   a.text AS en_text, b.text AS zh_text
            FROM en_j a JOIN fr_j b ON a.source = b.source AND a.j = b.j)"""


def stage1_features_sql(start_step: int = 0) -> str:
    return f"""WITH {_docs_rows()},
{_spec(STAGE1_WEIGHTS)},
{_index('lm', 'lm_rows')},
{_index('tr', 'tr_rows')},
{_steps(['lm', 'tr'])},
{_draws('lm', start_step=start_step)},
{_draws('tr', start_step=start_step)},
{_lm_feats('lm')},
{_translate_examples('tr', post=False)},
{_s2s_feats('tr', "input || chr(10) || prompt")}
{_report('(SELECT * FROM lm_f UNION ALL SELECT * FROM tr_f)')}"""


def mix_schedule_sql(start_step: int = 0) -> str:
    return f"""WITH {_docs_rows()},
{_spec(STAGE1_WEIGHTS)},
{_index('lm', 'lm_rows')},
{_index('tr', 'tr_rows')},
{_steps(['lm', 'tr'])},
{_draws('lm', start_step=start_step)},
{_draws('tr', start_step=start_step)}
SELECT CAST(rank AS BIGINT) AS rank, CAST(batch_id AS BIGINT) AS batch_id, CAST(slot AS BIGINT) AS slot,
       CAST(global_pos AS BIGINT) AS global_pos, tag, file_name, CAST(doc_id AS BIGINT) AS doc_id,
       CAST(row_idx AS BIGINT) AS row_idx, CAST(draw AS BIGINT) AS draw
FROM (SELECT rank, batch_id, slot, global_pos, tag, file_name, doc_id, row_idx, draw FROM lm_draws
      UNION ALL SELECT rank, batch_id, slot, global_pos, tag, file_name, doc_id, row_idx, draw FROM tr_draws)"""


def _corpus(seed: int, shard_bytes: int) -> str:
    """documents as shards of a corpus: a tag's shard count from its bytes."""
    known = ", ".join(sql_str(t) for t, _ in CORPUS_WEIGHTS if t != "other")
    return f"""tagged AS (SELECT CASE WHEN lang IN ({known}) THEN lang ELSE 'other' END AS tag, doc_id, text,
                  {h(['doc_id'], f'order-{seed}')} AS place, coalesce(octet_length(encode(text)), 0) + 8 AS b FROM documents),
size AS (SELECT tag, least({shard_bytes}, CAST(ceil(sum(b) / {WORLD_SIZE}) AS BIGINT)) AS target FROM tagged GROUP BY tag),
lm_rows AS (SELECT tag, 'shard=' || (before // target) || '/' AS file_name, place, doc_id, text
            FROM (SELECT *, CAST(coalesce(sum(b) OVER (PARTITION BY tag ORDER BY place, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
                                 AS BIGINT) AS before FROM tagged) JOIN size USING (tag)),
{_spec(CORPUS_WEIGHTS)},
{_index('lm', 'lm_rows', 'r.place, r.doc_id')},
{_steps(['lm'])},
{_draws('lm')}"""


def stream_mix_sql(weights, arrivals: int, seed: int) -> str:
    """Arrivals in order; files of a tag go to ranks in turn, arrival by
    arrival; a batch comes out with the arrival that fills its last slot."""
    known = ", ".join(sql_str(t) for t, _ in weights)
    slot = lambda k: f"(({k}) // w * cyc + o + ({k}) % w)"
    return f"""WITH a AS (SELECT doc_id, text, CASE WHEN lang IN ({known}) THEN lang ELSE 'en' END AS tag, source AS file_name,
                   {h(['doc_id'], f'arrival-{seed}')} % {arrivals} AS epoch FROM documents),
{_spec(weights)},
files AS (SELECT epoch, tag, file_name, row_number() OVER (PARTITION BY tag ORDER BY epoch, file_name) - 1 AS ord
          FROM (SELECT DISTINCT epoch, tag, file_name FROM a)),
idx AS (SELECT a.*, ord % {WORLD_SIZE} AS rank, row_number() OVER (PARTITION BY a.tag, ord % {WORLD_SIZE} ORDER BY ord, doc_id) - 1 AS k
        FROM a JOIN files USING (epoch, tag, file_name)),
seen AS (SELECT e.epoch, r.rank, spec.tag, w, o, cyc, (SELECT count(*) FROM idx WHERE idx.tag = spec.tag AND idx.rank = r.rank AND idx.epoch <= e.epoch) AS n
         FROM range({arrivals}) e(epoch), range({WORLD_SIZE}) r(rank), spec),
full_ AS (SELECT epoch, rank, min({slot('n')}) // {BATCH_SIZE} AS n_batches FROM seen GROUP BY epoch, rank),
lm0 AS (SELECT idx.*, {slot('k')} AS global_pos FROM idx JOIN spec USING (tag)),
lm_draws AS (SELECT tag, rank, doc_id, text, global_pos, global_pos // {BATCH_SIZE} AS batch_id, global_pos % {BATCH_SIZE} AS slot FROM lm0),
{_lm_feats('lm')},
out AS ({_report('lm_f')})
SELECT out.*, CAST((SELECT min(epoch) FROM full_ f WHERE f.rank = out.rank AND f.n_batches > out.batch_id) AS BIGINT) AS epoch
FROM out WHERE EXISTS (SELECT 1 FROM full_ f WHERE f.rank = out.rank AND f.n_batches > out.batch_id)"""


def corpus_features_sql(seed: int, shard_bytes: int) -> str:
    return f"""WITH {_corpus(seed, shard_bytes)},
{_lm_feats('lm')}
{_report('lm_f')}"""


def corpus_schedule_sql(seed: int, shard_bytes: int) -> str:
    return f"""WITH {_corpus(seed, shard_bytes)}
SELECT CAST(rank AS BIGINT) AS rank, CAST(batch_id AS BIGINT) AS batch_id, CAST(slot AS BIGINT) AS slot, tag,
       CAST(doc_id AS BIGINT) AS doc_id, CAST(row_idx AS BIGINT) AS row_idx FROM lm_draws"""


def _task_examples(name: str) -> str:
    key = ["rank", "global_pos"]
    pos = f"['post', 'pre'][{h(key, 'prompt-pos')} % 2 + 1]"
    return f"""{name}_ex0 AS (
  SELECT d.*, {pos} AS pos0 FROM {name}_draws d),
{name}_ex1 AS (
  SELECT d.*, {rstrip('p.prompts[' + h(key, 'task-prompt') + ' % len(p.prompts) + 1]')} AS prompt,
         CASE WHEN p.prompts IS NOT NULL AND len(p.prompts) > 0 THEN d.pos0 END AS prompt_pos
  FROM {name}_ex0 d
  LEFT JOIN {values_pools(inputs.TASK_POOLS)}
         ON length(coalesce(d.type, '')) > 0 AND p.pool_key = d.type || '.' || d.pos0),
{name}_ex AS (
  SELECT *, {rstrip('output0')} AS output FROM (SELECT * EXCLUDE (output), output AS output0 FROM {name}_ex1))"""


def _stage2_prefix() -> str:
    return (f"(CASE WHEN prompt_pos = 'pre' THEN prompt || chr(10) || {rstrip('input')} || chr(10) || chr(10) "
            f"WHEN prompt_pos = 'post' THEN {rstrip('input')} || chr(10) || prompt || chr(10) "
            f"ELSE input || ' ' END)")


def stage2_features_sql() -> str:
    return f"""WITH lm_rows AS (SELECT lang AS tag, source AS file_name, doc_id, text FROM documents WHERE lang = 'en'),
en_j AS (SELECT source, doc_id, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS j
         FROM documents WHERE lang = 'en'),
fr_j AS (SELECT source, doc_id, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS j
         FROM documents WHERE lang = 'fr'),
tr_rows AS (SELECT 'translate' AS tag, a.source AS file_name, a.doc_id, b.doc_id AS pair_doc_id,
                   a.text AS en_text, b.text AS zh_text
            FROM en_j a JOIN fr_j b ON a.source = b.source AND a.j = b.j),
tk_rows AS (SELECT 'task-' || lang AS tag, source AS file_name, doc_id, text AS input,
                   string_split(text, chr(10))[1] AS output, source AS type
            FROM documents WHERE lang IN ('es', 'de')),
{_spec(STAGE2_WEIGHTS)},
{_index('lm', 'lm_rows')},
{_index('tr', 'tr_rows')},
{_index('tk', 'tk_rows')},
{_steps(['lm', 'tr', 'tk'])},
{_draws('lm')},
{_draws('tr')},
{_draws('tk')},
{_lm_feats('lm')},
{_translate_examples('tr0', post=True).replace('tr0_draws', 'tr_draws')},
tr_ex AS (SELECT *, 'post' AS prompt_pos FROM tr0_ex),
{_s2s_feats('tr', _stage2_prefix())},
{_task_examples('tk')},
{_s2s_feats('tk', _stage2_prefix())}
{_report('(SELECT * FROM lm_f UNION ALL SELECT * FROM tr_f UNION ALL SELECT * FROM tk_f)')}"""


def instruct_rows_sql() -> str:
    """Instruction records from conversations, stripped, with tag/file."""
    return f"""conv AS (SELECT conv_id, turn, role, text FROM conversations),
instr0 AS (
  SELECT u.conv_id, u.turn, coalesce(s.text, '') AS instruction, u.text AS input, a.text AS output
  FROM (SELECT * FROM conv WHERE role = 'user') u
  LEFT JOIN (SELECT * FROM conv WHERE role = 'system') s ON s.conv_id = u.conv_id AND s.turn + 1 = u.turn
  LEFT JOIN (SELECT * FROM conv WHERE role = 'assistant') a ON a.conv_id = u.conv_id AND a.turn - 1 = u.turn),
instr AS (
  SELECT conv_id, turn, {strip("coalesce(instruction, '')")} AS instruction, {strip("coalesce(input, '')")} AS input,
         {strip("coalesce(output, '')")} AS output FROM instr0)"""


def stage3_features_sql() -> str:
    from weftmix.plans.training import STAGE3_WEIGHTS
    B = 24
    prefix = ("'Human: ' || CASE WHEN length(instruction) > 0 THEN instruction || chr(10) ELSE '' END || "
              "CASE WHEN length(input) > 0 THEN input || chr(10) ELSE '' END || 'Assistant: '")
    return f"""WITH {instruct_rows_sql()},
ch_rows AS (
  SELECT CASE WHEN length(instruction) > 0 THEN 'chat-system' ELSE 'chat' END AS tag,
         repeat('0', 5 - length(CAST(conv_id // 16 AS VARCHAR))) || CAST(conv_id // 16 AS VARCHAR) || '.jsonl' AS file_name,
         conv_id * 1048576 + turn AS doc_id, instruction, input, output
  FROM instr WHERE length(instruction) + length(input) > 0),
{_spec(STAGE3_WEIGHTS)},
{_index('ch', 'ch_rows')},
{_steps(['ch'], B)},
{_draws('ch', B)},
ch_ex AS (SELECT * FROM ch_draws),
{_s2s_feats('ch', prefix)}
{_report('ch_f')}"""


def strip_fields_sql() -> str:
    return f"""WITH {instruct_rows_sql()}
SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, md5(instruction) AS instruction_md5,
       md5(input) AS input_md5, md5(output) AS output_md5, CAST(length(instruction) AS BIGINT) AS n_instruction,
       CAST(length(input) AS BIGINT) AS n_input, CAST(length(output) AS BIGINT) AS n_output,
       length(instruction) + length(input) > 0 AS valid
FROM instr"""
