"""Object-centric process analytics and corpus operators, written for Spark first."""
