"""pagelake: web-document analytics and corpus preparation on PySpark."""
