"""Record schemas of the tables the operators read and write."""

from pyspark.sql import types as T

_S, _I, _L, _D, _B = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, dtype, True) for name, dtype in fields.items()])


BRANCH = _struct(
    branch_name=_S, branch_url=_S, source_page=_S, depth=_I,
    is_up_link=_B, cluster_key=_S, is_seed=_B,
)

ITEM_URL = _struct(product_url=_S, url=_S)

PAGES = _struct(page_id=_L, url=_S, html=_S)

PAGE_RESULT = _struct(
    url=_S, asin=_S, title=_S, description=_S, has_video=_B, video_count=_I,
    video_urls=T.ArrayType(_S), planned_files=T.ArrayType(_S), downloaded_videos=T.ArrayType(_S),
    download_errors=T.ArrayType(_struct(video_url=_S, error=_S)),
    http_status=_I, blocked=_B, error=_S, signals=T.ArrayType(_S), elapsed_ms=_D,
)

SUMMARY = _struct(
    total=_L, with_video=_L, without_video=_L, blocked=_L, page_errors=_L,
    downloaded_products=_L, downloaded_videos=_L, download_errors=_L,
)

SCHEDULER_STATE = _struct(
    branch_index=_I, product_index=_I, current_branch_url=_S, current_branch_name=_S,
    branch_products=T.ArrayType(_S), uploaded_urls=T.ArrayType(_S), skipped_urls=T.ArrayType(_S),
    upload_error_by_url=T.MapType(_S, _S), last_upload_time=_S, last_uploaded_url=_S,
    last_completed_slot=_S,
)

UPLOAD_LOG = _struct(url=_S, youtube_url=_S, time=_S)

SCENE = _struct(start_sec=_D, end_sec=_D, visual_focus_english=_S, narration_malayalam=_S)

SEGMENT = _struct(
    scene_index=_I, start_sec=_D, end_sec=_D, duration_sec=_D,
    visual_focus_english=_S, narration_malayalam=_S,
)

ANALYSIS = _struct(
    visual_summary_english=_S, visual_highlights=T.ArrayType(_S), hook_line_malayalam=_S,
    target_audience_malayalam=_S, key_benefits_malayalam=T.ArrayType(_S),
    promo_script_malayalam=_S, short_cta_malayalam=_S, scene_segments=T.ArrayType(SCENE),
)

ARTIFACTS = _struct(key=_S, path=_S, mtime=T.TimestampType())
