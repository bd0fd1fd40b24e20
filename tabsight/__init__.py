"""Automated data analysis as Spark jobs: profile, explore, model and chart any table."""
