"""PySpark-native analytics for image-annotation, language-grounding and text-training datasets."""
