"""Schemas of the caption tables. Times are BIGINT milliseconds, intervals are half-open, a row's place is explicit."""

PIECE = "struct<start_ms:bigint,end_ms:bigint,text:string,translation:string,translation_start_ms:bigint,translation_echo:boolean>"
CUE = "doc_id bigint, cue_idx int, start_ms bigint, end_ms bigint, text string"
WORD = "doc_id bigint, word_idx int, start_ms bigint, end_ms bigint, text string"
SEGMENT = (
    "doc_id bigint, seg_idx int, start_ms bigint, end_ms bigint, text string, speaker_id int, confidence float, needs_review boolean, "
    f"review_reason string, translation string, translation_start_ms bigint, translation_echo boolean, merged_from array<{PIECE}>"
)
#: What a segment's columns are when nothing is known.
SEGMENT_DEFAULTS = {
    "speaker_id": "cast(-1 as int)", "confidence": "cast(0 as float)", "needs_review": "false", "review_reason": "''", "translation": "''",
    "translation_start_ms": "0L", "translation_echo": "false", "merged_from": f"cast(array() as array<{PIECE}>)",
}
BOX_DEFAULTS = {"x": "0.08D", "y": "0.70D", "w": "0.84D", "h": "0.20D"}
STYLE_DEFAULTS = {
    "box": "named_struct('x', 0.08D, 'y', 0.70D, 'w', 0.84D, 'h', 0.20D)", "auto_height": "true", "box_color": "'#ffcbe86b'", "text_color": "'#ff111111'",
    "box_opacity": "1.0D", "corner_radius": "0.010D", "padding_x": "0.022D", "padding_y": "0.016D", "font_family": "'Verdana'", "font_size": "0.062D",
    "font_weight": "500", "italic": "false", "line_spacing": "1.12D", "text_align": "132", "shadow_enabled": "false", "shadow_color": "'#8c000000'",
    "shadow_offset": "0.006D", "outline_enabled": "false", "outline_color": "'#ff000000'", "outline_width": "0.004D",
}
#: The fields of a project document, table by table: SQL literals, or a dictionary where one is an object itself.
_STYLE = STYLE_DEFAULTS | {"box": BOX_DEFAULTS}
TRANSLATION_STYLE = STYLE_DEFAULTS | {
    "box": "named_struct('x', 0.06D, 'y', 0.78D, 'w', 0.88D, 'h', 0.11D)", "box_color": "'#ff000000'", "box_opacity": "0.35D", "text_color": "'#ffffffff'",
    "corner_radius": "0.006D", "font_size": "0.042D", "font_weight": "400",
}
OVERLAY_DEFAULTS = {"name": "'Overlay'", "is_image": "true", "image_path": "''", "text": "''", "opacity": "1.0D", "keep_aspect": "true", "on_top": "false", "enabled": "true", "start_ms": "0L", "end_ms": "0L"}
EXPORT_DEFAULTS = {"output_path": "''", "video_codec": "'libx264'", "preset": "'medium'", "crf": "18", "audio_bitrate_kbps": "192"}
SETTINGS = {
    "audio_path": "''", "srt_path": "''", "canvas_width": "1920", "canvas_height": "1080", "fps": "30", "background_color": "'#ff000000'", "duration_ms": "0L",
    "translation_enabled": "true", "transition_ms": "140", "transition_rise": "0.0D", "translation_style": _STYLE, "export": EXPORT_DEFAULTS,
}
LISTS = {
    "speakers": {"name": "''", "tint": "'#ff4c9aff'", "style": _STYLE},
    "scenes": {"image_path": "''", "start_ms": "0L", "end_ms": "0L", "fit": "'cover'"},
    "highlights": {"word": "''", "color": "'#ff1e6fe8'", "bold": "false"},
    "overlays": OVERLAY_DEFAULTS | {"style": _STYLE},
}
#: What numbers the rows of a document's list.
PLACES = {"segments": "seg_idx", "speakers": "speaker_id", "scenes": "scene_idx", "highlights": "highlight_idx", "overlays": "overlay_idx"}
