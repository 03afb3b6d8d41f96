"""Schemas of the persistent tables. Digits stay strings; nothing is inferred."""

SCHEMAS = {
    "manifest": "crop_path string, video string, frame int, tag_idx int, bead_idx int, sam3_score double",
    "manifest_deduped": "crop_path string, video string, frame int, tag_idx int, bead_idx int, sam3_score double, cluster_size int",
    "ocr_all": "crop_path string, pred_text string, score double",
    "ocr_labels": "crop_path string, digit string, score double",
    "manual_labels": "crop_path string, digit string, rotation_deg int",
    "augmented_labels": "crop_path string, digit string, rotation_deg double, source_crop_path string",
    "disagreements": "crop_path string, recorded_digit string, model_prediction string, confidence double",
    "tag_crops": "track_id int, frame int, crop_path string, tag_det_conf double, snail_det_conf double",
    "detections": "video long, frame long, det_idx long, cls int, x1 double, y1 double, x2 double, y2 double, conf double",
    "coco": "images array<struct<id:long,file_name:string,width:int,height:int>>, annotations array<struct<id:long,image_id:long,category_id:int,bbox:array<double>,area:double,iscrowd:int,score:double>>, categories array<struct<id:int,name:string>>",
}
