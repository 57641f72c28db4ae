"""Schemas of the tables and documents."""

REGION = "struct<start:double,end:double>"
WORD = "struct<word:string,start:double,end:double,confidence:double,speaker:int>"
VARIATION = (
    "struct<rank_position:int,text:string,confidence:double,"
    "words:array<struct<word:string,confidence:double,start:double,end:double>>,"
    "model:string,model_description:string>"
)

RECORDINGS = (
    "id string, airport string, facility string, recorded_at timestamp, duration_seconds int,"
    " source_url string, raw_file_path string, status string, segment_count int,"
    " created_at timestamp, updated_at timestamp"
)
SEGMENTS = (
    "id string, recording_id string, segment_index int, file_path string,"
    " duration_seconds double, start_time_in_recording double, file_size_bytes int,"
    " audio_quality_score double, transcription_text string, transcription_confidence double,"
    " needs_human_review boolean, rlhf_candidate boolean, label_count int, status string,"
    f" created_at timestamp, trimmed_file_path string, remove_regions array<{REGION}>,"
    f" unknown_regions array<{REGION}>, split_into_chunks int, is_chunk boolean,"
    " parent_segment_id string, chunk_index int, reviewed boolean, reviewed_at timestamp,"
    " review_notes string, reviewed_by string, active boolean, flagged boolean,"
    " edge_case_score double, speaker_count int, audio_analysis_score double,"
    " detected_patterns array<string>"
)
LABELS = (
    "id string, segment_id string, user_id string, transcription string, response string,"
    " confidence string, replay_count int, time_spent_seconds int, created_at timestamp"
)
MODEL_OUTPUTS = (
    f"id string, segment_id string, variations array<{VARIATION}>, needs_ranking boolean,"
    " overall_ranking array<int>, detailed_scores map<string, struct<accuracy:int,"
    "completeness:int,clarity:int,note:string>>, notes string, ranked_at timestamp,"
    " ranking_time_seconds int, created_at timestamp"
)
FEEDS = "feed_id string, airport string, facility string, url string"
TRAINING_METADATA = (
    "audio string, text string, duration double, source string,"
    " augmentation struct<type:string,params:struct<factor:double,semitones:int,dbChange:int,"
    "noiseLevel:double>>, processing struct<normalized:boolean,airband_filtered:boolean>,"
    " metadata struct<segment_id:string,label_id:string,original_audio:string,chunk_index:int,"
    "context:string>"
)
_STEP = (
    "struct<status:string,duration:bigint,outputPath:string,segmentCount:int,outputDir:string,"
    "error:string>"
)
RUN_LOG = (
    "feed struct<airport:string,facility:string,url:string>, startTime string, status string,"
    f" steps struct<record:{_STEP},segment:{_STEP},upload:{_STEP}>, error string,"
    " totalDuration bigint"
)
SEGMENTATION = (
    "success boolean, inputPath string, outputDir string, segmentCount int,"
    " segments array<struct<index:int,filename:string,path:string,startTime:double,"
    "duration:double,fileSize:bigint,qualityScore:double>>"
)
