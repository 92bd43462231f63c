"""Text of the domain views for the comparison queries; dependencies are listed before dependants."""

from __future__ import annotations

VIEWS = {
    "fx_detections": """
select *, row_number() over (partition by video_id, frame_idx order by obj_id) - 1 as det_idx from (
  select user_id % 10 + 10 * (row_number() over (partition by user_id, (epoch(ts)::bigint - 1704067200) // 3600 order by event_id) - 1) as video_id,
         (epoch(ts)::bigint - 1704067200) // 3600 as frame_idx, user_id as obj_id, event_id,
         least(value / 100.0, 1.0) as conf,
         (user_id // 10 % 20) * 100 + ((epoch(ts)::bigint - 1704067200) // 3600) % 8 as x1, (user_id // 200) * 120 as y1,
         (user_id // 10 % 20) * 100 + ((epoch(ts)::bigint - 1704067200) // 3600) % 8 + 60 as x2, (user_id // 200) * 120 + 90 as y2,
         2100 as frame_w, 1080 as frame_h,
         case when event_type = 'error' then 'UNKNOWN' else event_type end as sku_pred
  from events)
""",
    "fx_frames": """
select video_id, unnest(range((select max(frame_idx) + 1 from fx_detections))) as frame_idx, 30.0 as fps
from (select distinct video_id from fx_detections)
""",
    "fx_raw_boxes": """
select l_orderkey, l_linenumber, l_orderkey % 20 as video_id, l_partkey % 200 as frame_idx,
       (l_partkey * 37) % 1900 as x1, (l_suppkey * 53) % 1000 as y1,
       least(1920, (l_partkey * 37) % 1900 + 1 + (l_orderkey * 7) % 1200) as x2,
       least(1080, (l_suppkey * 53) % 1000 + 1 + (l_suppkey * 13 + l_linenumber * 101) % 700) as y2,
       (l_orderkey % 100) / 100.0 as conf, 1920 as frame_w, 1080 as frame_h from lineitem
""",
    "fx_votes": """
select user_id * 100 + day(ts) as track_id, user_id % 10 as video_id,
       case when event_type = 'error' then 'UNKNOWN' else event_type end as sku,
       least(value / 100.0, 1.0) as sim,
       row_number() over (partition by user_id, day(ts) order by ts, event_id) as frame_idx from events
""",
    "fx_catalog_ref": """
select vec_id as ref_id, 'EAN' || lpad(label::varchar, 3, '0') as ean,
       ['botella','lata','bolsa'][label % 3 + 1] as categoria, embedding from embeddings
""",
    "fx_query": """
select vec_id as crop_id, list_transform(range(64), lambda i: case when i % (1 + vec_id % 8) = 0 then embedding[i+1] else 0 end) as embedding from embeddings
""",
    "fx_prompts": """
select vec_id as prompt_id, ['botella','lata','bolsa','frasco'][label % 4 + 1] as categoria, embedding from embeddings
""",
    "fx_split": """
select vec_id as crop_id, list_transform(range(64), lambda i: case when i % (1 + vec_id % 8) = 0 then embedding[i+1] else 0 end) as full_vec,
       list_transform(range(64), lambda i: case when i < 32 and i % (1 + vec_id % 8) = 0 then embedding[i+1] else 0 end) as left_vec,
       list_transform(range(64), lambda i: case when i >= 32 and i % (1 + vec_id % 8) = 0 then embedding[i+1] else 0 end) as right_vec,
       0 as x1, 0 as y1, 60 + vec_id * 7 % 90 as x2, 60 as y2, 400 as frame_w, 400 as frame_h, (vec_id * 13 % 100) / 100.0 as conf
from embeddings
""",
    "fx_packaging": """
select distinct p_type as id, p_type as nombre, true as activo from part union all select 'VACIO','VACIO',true union all select 'RETIRADO','RETIRADO',false
""",
    "fx_products": """
select p_partkey as ean, p_name || ' ' || p_brand as descripcion, p_type as packaging_type_id, p_brand as brand,
       case when p_size % 5 = 0 then null else p_size::varchar end as size, p_size as n_imagenes,
       p_partkey % 3 <> 0 as embeddings_calculados, p_partkey % 10 <> 9 as activo from part
""",
    "fx_incoming": """
select p_partkey as ean, case when p_partkey % 6 = 0 then p_name || ' NUEVO' else p_name || ' ' || p_brand end as descripcion,
       case when p_partkey % 97 = 6 then 'NO_EXISTE' else p_type end as packaging_type_id, p_brand as brand,
       case when p_size % 5 = 0 then null else p_size::varchar end as size from part where p_partkey % 3 = 0
union all select p_partkey + 1000000, p_name, p_type, p_brand, null from part where p_partkey % 50 = 1
""",
    "fx_runs": """
select o_orderkey as id, 'V' || (o_custkey % 50)::varchar as video_nombre, o_orderdate as fecha, (o_custkey % 90 + 10) as frames_procesados from orders
""",
    "fx_run_items": """
select l_orderkey as ejecucion_id, l_partkey as ean, l_linenumber as tracking_id, l_quantity::int as cantidad_dedup,
       l_quantity::int + l_linenumber as cantidad_raw, round(l_discount * 10, 2) as confianza_promedio from lineitem
""",
    "fx_review": """
select d.doc_id as idx, d.doc_id % 25 as run_id, 'crop_' || d.doc_id::varchar as crop_id,
       case when d.doc_id % 2 = 0 then 'unknown' else 'ambiguous' end as decision,
       case when l.doc_id is null then 'pending' when l.toxic = 1 then 'discarded' when l.quality = 1 then 'labeled' else 'skipped' end as status,
       case when l.quality = 1 and coalesce(l.toxic,0) = 0 then d.doc_id % 40 end as assigned_ean
from documents d left join labels l using (doc_id)
""",
    "fx_images": """
select doc_id as seq, doc_id % 40 as ean, 'http://' || source || '/' || doc_id::varchar as url, sha256(text) as sha256, n_chars * 40 as bytes,
       case doc_id % 7 when 0 then 'text/html' when 1 then 'image/png' when 2 then 'image/webp; q=1' else 'image/jpeg' end as content_type,
       case when doc_id % 11 = 0 then null else 200 + n_chars % 400 end as width,
       case when doc_id % 11 = 0 then null else 250 + n_chars % 300 end as height from documents
""",
    "fx_frame_metrics": """
select user_id as video_id, row_number() over (partition by user_id order by ts, event_id) - 1 as idx,
       least(255.0, value * 2.2) as brightness, least(90.0, value) as contrast, value * 3 as sharpness,
       case when user_id % 2 = 0 then 1920 else 1080 end as width, case when user_id % 2 = 0 then 1080 else 1920 end as height from events
""",
}


def with_views(body: str) -> str:
    """Prefix ``body`` with the views it names, and those that these name."""
    text = body
    for name in reversed(VIEWS):
        text += VIEWS[name] if name in text else ""
    used = [name for name in VIEWS if name in text]
    head = ",\n".join(f"{name} AS ({VIEWS[name].strip()})" for name in used)
    body = body.strip()
    if not head:
        return body
    if body[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {head},\n{body[15:]}"
    if body[:5].upper() == "WITH ":
        return f"WITH {head},\n{body[5:]}"
    return f"WITH {head}\n{body}"
